"""Question / answer taxonomy over a QA table.

All map-side: native expressions in one projection, no shuffle until a
report aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import text_preprocess


def feature_table(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """The 13 question flags plus the answer type, one row per input row."""
    return df.withColumns(C.feature_columns(F.col(question), F.col(answer)))


def with_answer_type(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """C21 as a column."""
    return df.withColumn("answer_type", C.answer_type(F.col(question), F.col(answer)))


def answer_type_counts(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Report: rows per answer type (partial + final hash aggregate)."""
    return (with_answer_type(df, question, answer)
            .groupBy("answer_type").agg(F.count(F.lit(1)).alias("n")))


def temporal_only(df: DataFrame, question: str = "question", answer: str = "answer",
                  preprocess: bool = True) -> DataFrame:
    """keep temporal questions.  ``preprocess`` applies N7 first, as the
    reference's callers do."""
    q, a = F.col(question), F.coalesce(F.col(answer), F.lit(""))
    if preprocess:
        q, a = text_preprocess(q), text_preprocess(a)
    return df.where(C.bound(q, a, C.is_temporal))


def sentences(text: str) -> Column:
    """N7, then the whole text cut after each sentence mark and at line ends."""
    marked = F.regexp_replace(text_preprocess(F.col(text)), "([.!?])", "$1\n")
    return F.split(marked, "\n")


def flag_counts(df: DataFrame, by: str, text: str, flags) -> DataFrame:
    """How many rows of each group raise each flag (one pass, map-side partial sums)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(fn(F.col(text)).cast("long")).alias(f"n_{name}") for name, fn in flags.items()]
    return df.groupBy(by).agg(*aggs)
