"""Queries over the question taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import taxonomy as T
from ..sources.fixtures import view, with_clause
from ..sources.tables import spread, table
from . import sqlx as X
from .registry import register

_DOC_FLAGS = {
    "max": C.max_operator, "min": C.min_operator, "count": C.count_operator,
    "sum": C.sum_operator, "difference": C.difference_operator,
    "average": C.average_operator, "comparison": C.comparison_operator,
    "before": C.before_related, "after": C.after_related,
}
_DOC_FLAGS_SQL = {
    "max": X.max_operator, "min": X.min_operator, "count": X.count_operator,
    "sum": X.sum_operator, "difference": X.difference_operator,
    "average": X.average_operator, "comparison": X.comparison_operator,
    "before": X.before_related, "after": X.after_related,
}


def _answer_type_sql():
    return with_clause(["v_qa"]) + f"""
SELECT answer_type, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {X.answer_type('question', 'answer')} AS answer_type FROM v_qa) t
GROUP BY answer_type"""


def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select("lang", "text"), docs)


@register("answer_type", "C21 C8 C15-C19 N5 P2 X3", _answer_type_sql)
def answer_type(spark, sf_dir):
    return T.answer_type_counts(view(spark, sf_dir, "v_qa"))


def _feature_table_sql():
    flags = ",\n  ".join(f"{fn('question')} AS {name}" for name, fn in X.FLAGS.items())
    return with_clause(["v_qa"]) + f"""
SELECT row_id, {flags},
  {X.answer_type('question', 'answer')} AS answer_type
FROM v_qa"""


@register("feature_table", "C1-C14 C21 C22 P2 X2 X3", _feature_table_sql)
def feature_table(spark, sf_dir):
    df = view(spark, sf_dir, "v_qa")
    return T.feature_table(df).drop("table_id", "category", "name", "question", "answer")


def _flag_docs_sql():
    cols = ",\n  ".join(
        f"CAST(sum(CASE WHEN {fn('text')} THEN 1 ELSE 0 END) AS BIGINT) AS n_{name}"
        for name, fn in _DOC_FLAGS_SQL.items())
    return f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n,
  {cols}
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY lang"""


@register("flag_operators_documents", "C1-C7 C9 C10 P2 X2 (every line of the documents)", _flag_docs_sql)
def flag_operators_documents(spark, sf_dir):
    """A classifier reads one line, so a document is classified line by line."""
    lines = _documents(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("text"))
    return T.flag_counts(lines, "lang", "text", _DOC_FLAGS)


def _flags_qa_sql():
    names = ["before_related", "after_related", "duration_related", "explicit", "implicit", "ordinal"]
    cols = ",\n  ".join(
        f"CAST(sum(CASE WHEN {X.FLAGS[n]('question')} THEN 1 ELSE 0 END) AS BIGINT) AS n_{n}" for n in names)
    yn = X.yes_no("question", X.lit_replace("lower(answer)", X.P.NUMBER_WORDS_12))
    return with_clause(["v_qa"]) + f"""
SELECT category, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN {yn} THEN 1 ELSE 0 END) AS BIGINT) AS n_yes_no,
  {cols}
FROM v_qa GROUP BY category"""


@register("flag_temporal_relations", "C8-C14 by category", _flags_qa_sql)
def flag_temporal_relations(spark, sf_dir):
    from ..functions.text import number_words_12
    df = view(spark, sf_dir, "v_qa")
    names = ["before_related", "after_related", "duration_related", "explicit", "implicit", "ordinal"]
    q = F.col("question")
    yn = C.yes_no(q, number_words_12(F.lower(F.col("answer"))))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(yn.cast("long")).alias("n_yes_no")]
    aggs += [F.sum(C.FLAG_FUNCTIONS[n](q).cast("long")).alias(f"n_{n}") for n in names]
    return df.groupBy("category").agg(*aggs)


def _answer_flags_sql():
    qc, ac = "lower(question)", X.lit_replace("lower(answer)", X.P.NUMBER_WORDS_12)
    parts = {
        "temporal": X.temporal_answer(qc, ac), "count": X.count_answer(qc, ac),
        "age": X.age_answer(qc, ac), "money": X.money_answer(qc, ac),
        "percentage": X.percentage_answer(qc, ac), "rank": X.rank_answer(qc, ac),
    }
    cols = ",\n  ".join(f"{v} AS is_{k}" for k, v in parts.items())
    return with_clause(["v_qa"]) + f"SELECT row_id,\n  {cols}\nFROM v_qa"


@register("answer_shape_flags", "C15-C19 X3", _answer_flags_sql)
def answer_shape_flags(spark, sf_dir):
    from ..functions.text import number_words_12
    df = view(spark, sf_dir, "v_qa")
    q, a = F.lower(F.col("question")), number_words_12(F.lower(F.col("answer")))
    return df.select(
        "row_id",
        C.temporal_answer(q, a).alias("is_temporal"),
        C.count_answer(q, a).alias("is_count"),
        C.age_cardinal_answer(q, a).alias("is_age"),
        C.money_answer(q, a).alias("is_money"),
        C.percentage_answer(q, a).alias("is_percentage"),
        C.rank_answer(q, a).alias("is_rank"),
    )


def _is_temporal_qa_sql():
    return with_clause(["v_qa"]) + f"""
SELECT row_id, table_id, question FROM v_qa
WHERE {X.is_temporal(X.text_preprocess('question'), X.text_preprocess("coalesce(answer, '')"))}"""


@register("is_temporal_filter", "C20 F5 N5-N7", _is_temporal_qa_sql)
def is_temporal_filter(spark, sf_dir):
    return T.temporal_only(view(spark, sf_dir, "v_qa")).select("row_id", "table_id", "question")


def _is_temporal_docs_sql():
    ends = f"regexp_replace({X.text_preprocess('text')}, '([.!?])', '\\1' || chr(10), 'g')"
    return f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(s)) AS BIGINT) AS n_sentences,
       CAST(sum(CASE WHEN len(list_filter(s, lambda x: {X.is_temporal('x', "''")})) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_temporal
FROM (SELECT lang, string_split({ends}, chr(10)) AS s FROM documents) d GROUP BY lang"""


@register("is_temporal_documents", "C20 F5 N7 (every sentence of the documents)", _is_temporal_docs_sql)
def is_temporal_documents(spark, sf_dir):
    """Documents with a temporal sentence: the classifier reads a question, so a
    whole text is read sentence by sentence."""
    docs = _documents(spark, sf_dir).select("lang", T.sentences("text").alias("s"))
    flag = F.coalesce(F.exists("s", lambda x: C.is_temporal(x, F.lit(""))), F.lit(False))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("s")).alias("n_sentences"),
                                    F.sum(flag.cast("long")).alias("n_temporal"))
