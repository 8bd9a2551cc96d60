"""Resume queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import resume as R
from ..operators import taxonomy as T
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import view, with_clause
from ..streaming.resumable import read_sink, run_available
from . import sqlx as X
from .registry import register


@register("resume_pending", "J8 O2 F6", lambda: with_clause(["v_pred"]) + """
SELECT q.row_id, q.table_id, q.question FROM v_qa q
WHERE NOT EXISTS (SELECT 1 FROM v_pred p WHERE p.model = 'gpt-4' AND p.predicted_answer IS NOT NULL
                  AND p.predicted_answer NOT IN ('res', 'haa')
                  AND p.table_id = q.table_id AND p.question = q.question)""")
def resume_pending(spark, sf_dir):
    done = R.successful(view(spark, sf_dir, "v_pred").where(F.col("model") == "gpt-4"))
    return R.pending(view(spark, sf_dir, "v_qa"), done).select("row_id", "table_id", "question")


@register("resume_stream", "X1 S7 (two runs, exactly once)", lambda: with_clause(["v_qa"]) + f"""
SELECT row_id, table_id, question, {X.answer_type('question', 'answer')} AS answer_type FROM v_qa""")
def resume_stream(spark, sf_dir):
    """A run that stops half way, then resumes; a tenth of its keys arrive in both
    parts: the sink must hold every row once."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/resume-{uuid.uuid4().hex}"
    src, sink, ckpt = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    qa = view(spark, sf_dir, "v_qa").select("row_id", "table_id", "category", "question", "answer")
    first = qa.where(F.col("category") < "f")
    rest = qa.where(~(F.col("category") < "f") | (F.col("row_id") % 10 == 0))

    def process(batch):
        return T.with_answer_type(batch).select("row_id", "table_id", "question", "answer_type")

    first.write.mode("append").parquet(src)
    run_available(spark, src, sink, ckpt, qa.schema, process, keys=["row_id"])
    rest.write.mode("append").parquet(src)
    run_available(spark, src, sink, ckpt, qa.schema, process, keys=["row_id"])
    run_available(spark, src, sink, ckpt, qa.schema, process, keys=["row_id"])  # nothing new: no-op
    return read_sink(spark, sink).select("row_id", "table_id", "question", "answer_type")
