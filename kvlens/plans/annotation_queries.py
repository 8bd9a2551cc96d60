"""Annotation consolidation queries (E1: S2 P1 P4 P5 F1 F2 D1 A1 A3 A4 A8 N8-N15 M10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import parse_list_literal, py_list_repr
from ..operators import annotate as A
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import LIST_ITEMS, view, with_clause
from ..sources.tables import read_csv_glob, write_table
from . import sqlx as X
from .registry import register


def _long_sql():
    parts = " UNION ALL ".join(
        f"SELECT row_id * 3 + {j - 1} AS row_id, assignment_id, worker_id, status, table_html, table_id, name, "
        f"category, {j} AS q_no, question{j} AS question, gold{j} AS gold_answer, answer{j} AS answer, "
        f"explanation{j} AS explanation FROM v_batches" for j in (1, 2, 3))
    swap = "(table_id IS NOT NULL AND NOT regexp_matches(table_id, '^[0-9]+$'))"
    return with_clause(["v_batches"]).rstrip() + f""",
u AS ({parts}),
f AS (SELECT * FROM u WHERE question IS NOT NULL AND answer IS NOT NULL AND status IS DISTINCT FROM 'Rejected'),
long AS (SELECT row_id, assignment_id, worker_id, status, table_html, category, q_no, question, gold_answer,
                answer, explanation,
                CASE WHEN {swap} THEN name ELSE table_id END AS table_id,
                CASE WHEN {swap} THEN table_id ELSE name END AS name FROM f)
"""


def _union_sql():
    return with_clause(["v_batches"]) + """
SELECT batch, status, CAST(count(*) AS BIGINT) AS n,
       CAST(count(CASE WHEN batch <> '2' THEN approve END) AS BIGINT) AS n_approve,
       CAST(sum(length(question1)) AS BIGINT) AS question_chars,
       CAST(sum(length(answer3)) AS BIGINT) AS answer_chars, min(gold2) AS least_gold
FROM v_batches GROUP BY batch, status"""


@register("annot_union_prune", "S2 P1 D1 F7 (CSV batches with drifting headers)", _union_sql)
def annot_union_prune(spark, sf_dir):
    """Three folders of CSV batches, read back by name: the second has its
    columns in another order, the third has lost its Approve column."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    wide = view(spark, sf_dir, "v_batches").select("batch", *A.WIDE_COLUMNS)
    for b in range(3):
        part = wide.where(F.col("batch") == str(b))
        part = part.select(*reversed(part.columns)) if b == 1 else part.drop("approve") if b == 2 else part
        write_table(part, f"{base}/{b}", fmt="csv")
    schema = ", ".join(f"{c} STRING" for c in ["batch", *A.WIDE_COLUMNS])
    pruned = A.prune(read_csv_glob(spark, f"{base}/*/*.csv", schema))
    return pruned.groupBy("batch", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count("approve").alias("n_approve"),
        F.sum(F.length("question1")).alias("question_chars"), F.sum(F.length("answer3")).alias("answer_chars"),
        F.min("gold2").alias("least_gold"))


def _lists_sql():
    lists = ", ".join(f"string_agg({c}, '|' ORDER BY row_id) AS {c}s"
                      for c in ("assignment_id", "worker_id", "answer", "explanation"))
    return _long_sql() + f"""
SELECT question, table_id, CAST(row_id >> 12 AS BIGINT) AS part, {lists}
FROM long WHERE table_id IS NOT NULL GROUP BY question, table_id, CAST(row_id >> 12 AS BIGINT)"""


@register("annot_parallel_lists", "A3 (bounded parts of a group's lists)", _lists_sql)
def annot_parallel_lists(spark, sf_dir):
    lists = A.group_lists(A.long_answers(view(spark, sf_dir, "v_batches")))
    return lists.select("question", "table_id", F.col("part").cast("long").alias("part"), *[
        F.array_join(c, "|").alias(c) for c in ("assignment_ids", "worker_ids", "answers", "explanations")])


def _unpivot_sql():
    return _long_sql() + "SELECT row_id, q_no, assignment_id, table_id, name, question, answer FROM long"


@register("annot_unpivot_filter", "P5 F1 F2 P4 N24", _unpivot_sql)
def annot_unpivot_filter(spark, sf_dir):
    return (A.long_answers(view(spark, sf_dir, "v_batches"))
            .select("row_id", "q_no", "assignment_id", "table_id", "name", "question", "answer"))


def _group_sql():
    return _long_sql() + """
SELECT question, table_id, CAST(count(*) AS BIGINT) AS n_assignments,
       CAST(count(DISTINCT worker_id) AS BIGINT) AS n_workers,
       arg_min(name, row_id) AS name, arg_min(category, row_id) AS category,
       arg_min(gold_answer, row_id) AS gold_answer, arg_min(table_html, row_id) AS table_html
FROM long WHERE table_id IS NOT NULL GROUP BY question, table_id"""


@register("annot_group_lists", "A1 A3 A4 J1 O1", _group_sql)
def annot_group_lists(spark, sf_dir):
    return A.group_summary(A.long_answers(view(spark, sf_dir, "v_batches")))


def _vote_sql():
    return _long_sql().rstrip() + f""",
base AS (SELECT * FROM long WHERE table_id IS NOT NULL),
gold AS (SELECT question, table_id, arg_min(gold_answer, row_id) AS gold_answer, count(*) AS n_answers
         FROM base GROUP BY question, table_id),
gold2 AS MATERIALIZED (SELECT *, {X.normalise_gold("coalesce(gold_answer, 'nan')")} AS corrected_gold FROM gold),
al AS MATERIALIZED (SELECT b.question, b.table_id, b.row_id, {X.normalise_answer('b.answer')} AS norm,
                           g.corrected_gold
                    FROM base b JOIN gold2 g ON b.question = g.question AND b.table_id = g.table_id),
al2 AS (SELECT *, {X.align_to_gold('norm', 'corrected_gold')} AS corrected FROM al),
cnt AS (SELECT question, table_id, corrected, count(*) AS cnt, min(row_id) AS first_row
        FROM al2 GROUP BY question, table_id, corrected),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, table_id
                                                    ORDER BY cnt DESC, first_row ASC) AS rn FROM cnt) t
        WHERE rn = 1)
SELECT g.question, g.table_id, g.corrected_gold, w.corrected AS majority_answer,
       CAST(w.cnt AS BIGINT) AS score, CAST(g.n_answers AS BIGINT) AS n_answers,
       round(w.cnt / g.n_answers, 6) AS share
FROM gold2 g JOIN win w ON g.question = w.question AND g.table_id = w.table_id"""


@register("annot_vote", "N4 N8-N15 A8 O3 M10", _vote_sql)
def annot_vote(spark, sf_dir):
    return A.vote(A.long_answers(view(spark, sf_dir, "v_batches")))


def _repr_sql(x: str) -> str:
    """Python's repr of the few hidden characters the view holds."""
    b = "chr(92)"
    esc = f"replace({x}, {b}, {b} || {b})"
    for ch, code in (("chr(10)", "n"), ("chr(9)", "t"), ("chr(8203)", "u200b")):
        esc = f"replace({esc}, {ch}, {b} || '{code}')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', {b} || '''') || '''' END")


def _vote_lists_sql():
    items = " ".join(f"WHEN {i} THEN [{', '.join(x)}]" for i, x in enumerate(LIST_ITEMS) if x)
    return with_clause(["v_lists"]).rstrip() + f""",
parsed AS MATERIALIZED (
  SELECT v.row_id, {X.normalise_gold('v.gold_answer')} AS g,
         CASE CAST(floor(o.o_orderkey / 6) AS BIGINT) % 8 {items} ELSE []::VARCHAR[] END AS items
  FROM v_lists v JOIN orders o ON o.o_orderkey = v.row_id),
each AS MATERIALIZED (SELECT row_id, g, items[i] AS item, {X.normalise_answer('items[i]')} AS norm, i FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM parsed)),
al AS MATERIALIZED (SELECT *, {X.align_to_gold('norm', 'g')} AS fixed FROM each),
counted AS (SELECT row_id, fixed, count(*) AS n, min(i) AS first FROM al GROUP BY row_id, fixed),
won AS (SELECT row_id, arg_max(fixed, n * 1000 - first) AS majority_answer, max(n) AS score FROM counted GROUP BY row_id),
shown AS (SELECT row_id, string_agg(fixed, '|' ORDER BY i) AS corrected, '[' || string_agg({_repr_sql('item')}, ', ' ORDER BY i) || ']' AS literal FROM al GROUP BY row_id)
SELECT p.row_id, p.g AS corrected_gold, CAST(len(p.items) AS BIGINT) AS n_answers, coalesce(s.corrected, '') AS corrected, coalesce(s.literal, '[]') AS literal,
       coalesce(w.majority_answer, '') AS majority_answer, CAST(coalesce(w.score, 1) AS BIGINT) AS score
FROM parsed p LEFT JOIN won w USING (row_id) LEFT JOIN shown s USING (row_id)"""


@register("annot_vote_lists", "N15 A8 N25 N4 N8-N14 on list literals (escapes, ties, empty lists)", _vote_lists_sql)
def annot_vote_lists(spark, sf_dir):
    found = A.vote_lists(view(spark, sf_dir, "v_lists"))
    return found.select("row_id", "corrected_gold", "n_answers", F.array_join("corrected", "|").alias("corrected"),
                        py_list_repr(parse_list_literal(F.col("answers"))).alias("literal"), "majority_answer", "score")
