"""Split, id and lookup queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits as SP
from ..session import materialise
from ..sources.fixtures import view, with_clause
from .registry import register

TAIL = ("machinery",)

_LOOKUPS = """,
tq AS (SELECT DISTINCT table_id, question FROM v_qa),
la AS (SELECT table_id, question, arg_max(answer, row_id) AS answer FROM v_qa GROUP BY table_id, question),
ans AS (SELECT tq.table_id, tq.question, la.answer FROM tq JOIN la ON tq.table_id = la.table_id
        AND tq.question = la.question),
tcat AS (SELECT table_id, arg_max(category, row_id) AS category FROM v_qa GROUP BY table_id)
"""


@register("table_ids_first_seen", "W1 A2", lambda: with_clause(["v_batches"]) + """
SELECT table_html, CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS BIGINT) AS table_seq
FROM v_batches GROUP BY table_html""")
def table_ids_first_seen(spark, sf_dir):
    return SP.first_seen_ids(view(spark, sf_dir, "v_batches"), "table_html")


@register("category_counts", "A5 A6 H7", lambda: with_clause(["v_qa"]) + """
SELECT category, CAST(count(DISTINCT table_id) AS BIGINT) AS n_tables,
       CAST(count(DISTINCT CAST(table_id AS STRING) || chr(1) || question) AS BIGINT) AS n_questions
FROM v_qa GROUP BY category""")
def category_counts(spark, sf_dir):
    return SP.category_counts(view(spark, sf_dir, "v_qa"))


@register("category_sketches", "A6 (approximate: sketches stored per batch, merged, held against the exact counts)", lambda: with_clause(["v_qa"]) + """
SELECT category, CAST(count(DISTINCT table_id) AS BIGINT) AS n_tables,
       CAST(count(DISTINCT CAST(table_id AS STRING) || chr(1) || question) AS BIGINT) AS n_questions,
       true AS tables_within, true AS questions_within
FROM v_qa GROUP BY category""")
def category_sketches(spark, sf_dir):
    """Three batches that share tables are sketched and stored one by one; the merged
    sketches estimate the counts of all rows."""
    qa = view(spark, sf_dir, "v_qa")
    stored = [materialise(SP.category_sketches(qa.where(F.col("row_id") % 3 == b)), "sketches") for b in range(3)]
    estimate = SP.sketch_counts(SP.merge_sketches(reduce(DataFrame.unionByName, stored)))
    both = SP.category_counts(qa).join(estimate.select("category", F.col("n_tables").alias("t"), F.col("n_questions").alias("q")), "category")
    within = lambda exact, est: F.abs(F.col(est) - F.col(exact)) <= F.greatest(F.lit(1.0), F.col(exact) * SP.sketch_error())
    return both.select("category", "n_tables", "n_questions", within("n_tables", "t").alias("tables_within"), within("n_questions", "q").alias("questions_within"))


@register("qa_last_wins", "A7 J4", lambda: with_clause(["v_qa"]) + """
SELECT table_id, question, arg_max(answer, row_id) AS answer, CAST(count(*) AS BIGINT) AS n_rows
FROM v_qa GROUP BY table_id, question""")
def qa_last_wins(spark, sf_dir):
    return SP.last_answers(view(spark, sf_dir, "v_qa"))


def _assign_sql():
    tail = ", ".join(f"'{c}'" for c in TAIL)
    return with_clause(["v_splits"]).rstrip() + _LOOKUPS + f"""
SELECT s.split, a.table_id, a.question, a.answer FROM v_splits s JOIN ans a ON s.table_id = a.table_id
UNION ALL
SELECT 'tail', a.table_id, a.question, a.answer FROM ans a
WHERE a.table_id IN (SELECT table_id FROM tcat WHERE category IN ({tail}))"""


@register("split_assign", "J3 J4 J5 J7 D2 S8", _assign_sql)
def split_assign(spark, sf_dir):
    return SP.eval_rows(view(spark, sf_dir, "v_qa"), view(spark, sf_dir, "v_splits"), TAIL)


def _train_sql():
    return with_clause(["v_splits"]).rstrip() + _LOOKUPS + """,
last_t AS (SELECT arg_max(table_id, first_row) AS table_id
           FROM (SELECT table_id, min(row_id) AS first_row FROM v_qa GROUP BY table_id) f)
SELECT a.table_id, a.question, a.answer FROM ans a
WHERE a.table_id NOT IN (SELECT table_id FROM v_splits) AND a.table_id NOT IN (SELECT table_id FROM last_t)"""


@register("split_train", "J6 D4 F3 F4", _train_sql)
def split_train(spark, sf_dir):
    qa = view(spark, sf_dir, "v_qa")
    return SP.train_rows(qa, view(spark, sf_dir, "v_splits"), sentinel_table_id=SP.last_table(qa))


@register("split_overlap", "D5", lambda: with_clause(["v_splits"]) + """
SELECT table_id FROM v_splits WHERE split = 'test'
INTERSECT SELECT table_id FROM v_splits WHERE split = 'dev'""")
def split_overlap(spark, sf_dir):
    return SP.overlap(view(spark, sf_dir, "v_splits"))
