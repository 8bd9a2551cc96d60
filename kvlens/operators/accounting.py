"""What becomes of every input row (J1, J2, H1, H6, F7): rows left out are counted,
by reason, in the pass that reads them.

``written`` writes a table once, with an ``outcome`` for every row, and observes
the outcomes while it writes.  The observation stands directly below the write, in
the stage whose tasks are committed once each, so a task or an executor lost on
the way counts nothing twice.  The work goes on from the written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise
from . import infobox as H
from .prompts import with_context


def written(df: DataFrame, step: str, outcome: Column, outcomes: list[str]) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """The written rows of ``df`` with ``outcome``, and (step, outcome, rows) of all
    ``outcomes``; a value that is none of them is counted as ``other``."""
    seen = Observation(step)
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in outcomes]
    table = materialise(df.withColumn("outcome", outcome).observe(seen, F.count(F.lit(1)).alias("rows"), *counts), f"counted-{step}")
    found = seen.get
    rows = [(step, o, found[o]) for o in outcomes]
    other = found["rows"] - sum(n for _, _, n in rows)
    return table, rows + ([(step, "other", other)] if other else [])


def answers(long: DataFrame):
    """Answers with a table id go to their (question, table) group; without one they have none."""
    return written(long, "answers", F.when(F.col("table_id").isNull(), "no_table_id").otherwise("grouped"), ["grouped", "no_table_id"])


def html_tables(tables: DataFrame):
    """H1: tables as ``table_id, slots``; those without an id or without a ``<tr>`` are named."""
    parsed = H.nested(tables, without_id=True)
    outcome = F.when(F.col("table_id").isNull(), "no_table_id").when(F.col("n_rows") == 0, "no_rows").otherwise("read")
    return written(parsed, "html_tables", outcome, ["read", "no_rows", "no_table_id"])


def documents(docs: DataFrame, doc_col: str = "doc"):
    """H6: JSON documents as ``table_id, slots``; texts that are no JSON object are named."""
    return written(H.nested_documents(docs, doc_col), "documents", F.col("status"), ["ok", "malformed"])


def questions(qa: DataFrame, table_text: DataFrame):
    """Questions with their table's text; those whose table is missing stay, without one."""
    found = with_context(qa, table_text, how="left")
    return written(found, "questions", F.when(F.col("context").isNull(), "missing_table").otherwise("bound"), ["bound", "missing_table"])


def ledger(spark, *counted: list[tuple[str, str, int]]) -> DataFrame:
    """The counts of several steps as rows ``step, outcome, n``."""
    return spark.createDataFrame([row for rows in counted for row in rows], "step string, outcome string, n long")
