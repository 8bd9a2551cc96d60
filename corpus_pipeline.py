"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``.

1. ``quality``: the attention classifier, fitted on the labelled documents that are not
   held out; documents that score below 0.7 go.
2. ``line_dedup``: passages that stand elsewhere before are cut out; ``n_chars``
   follows the text.  A document all of whose text stands elsewhere goes; one that
   was empty before stays.
3. ``near_dedup``: groups of similarity 0.8 or more on shingles of five words;
   the document of the smallest id stays.  Rows of one id stay or go together.
4. ``packing``: token sequences of at most 1024 ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm import line_dedup, mil_quality, minhash_dedup, packing
from kvlens.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mil_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_quality.with_score(docs, model).where(F.col("__score") >= 0.7).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_repeated(docs, n_lines="__lines", n_removed="__removed")
    left = cut.where((F.col("__removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = minhash_dedup.near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("packing", pack)]

#: The stages are no SQL (trained scores, token ids); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
