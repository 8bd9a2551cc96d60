"""Dataset splits and QA lookups.

The reference keeps literal dicts (category -> table ids).  Here a split
list is a DataFrame ``(split, category, table_id)`` so any assignment can be
passed in.  Joins against it are equi/semi/anti joins on ``table_id``; no
broadcast hint is forced: AQE turns a join into a broadcast only when the
measured runtime size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen_ids(df: DataFrame, key: str, order: str = "row_id", id_col: str = "table_seq", span: int = 20) -> DataFrame:
    """Dense ids 0.. by first appearance of ``key``.

    ``order`` is a unique whole number.  A global ``row_number`` window would run
    in one task; instead first appearances are dealt into ranges of ``2**span`` order
    values, which hold at most that many keys each.  The ranges' sizes (one row a
    range) are summed up in order, and each range numbers its own keys.
    """
    firsts = (df.groupBy(key).agg(F.min(order).cast("long").alias("_first"))
              .withColumn("_range", F.shiftright("_first", span)))
    sizes = firsts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_first"))
    return (firsts.withColumn("_at", within).join(starts, "_range")
            .select(key, (F.col("_start") + F.col("_at") - 1).cast("long").alias(id_col)))


def table_questions(qa: DataFrame) -> DataFrame:
    """A5: the set of questions per table (relational: distinct pairs)."""
    return qa.select("table_id", "question").dropDuplicates()


def last_answers(qa: DataFrame) -> DataFrame:
    """Per (table, question) the answer of the last row wins."""
    return qa.groupBy("table_id", "question").agg(
        F.max_by("answer", F.col("row_id")).alias("answer"), F.count(F.lit(1)).alias("n_rows"))


def table_category(qa: DataFrame) -> DataFrame:
    """Category per table, last row wins."""
    return qa.groupBy("table_id").agg(F.max_by("category", F.col("row_id")).alias("category"))


def category_counts(qa: DataFrame) -> DataFrame:
    """Tables per category (a table counts under every category it
    appears with, as the reference's sets do) and distinct questions."""
    return qa.groupBy("category").agg(
        F.countDistinct("table_id").alias("n_tables"),
        F.countDistinct("table_id", "question").alias("n_questions"))


SKETCH_BITS = 12  # registers of a sketch: 2**12, a few kilobytes


def category_sketches(qa: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """A6, approximate: one HyperLogLog sketch of table ids and one of (table,
    question) pairs per category.  Sketches of several batches can be stored and merged
    later, without the rows."""
    pair = F.concat(F.col("table_id").cast("string"), F.lit("\x01"), F.col("question"))
    return qa.groupBy("category").agg(F.hll_sketch_agg("table_id", bits).alias("tables"), F.hll_sketch_agg(pair, bits).alias("questions"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of all batches as one per category."""
    return sketches.groupBy("category").agg(F.hll_union_agg("tables").alias("tables"), F.hll_union_agg("questions").alias("questions"))


def sketch_counts(sketches: DataFrame) -> DataFrame:
    """Estimates ``n_tables`` and ``n_questions``."""
    return sketches.select("category", F.hll_sketch_estimate("tables").alias("n_tables"), F.hll_sketch_estimate("questions").alias("n_questions"))


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The relative error that a merged sketch keeps in 997 of 1,000 cases (three
    standard errors of 1.04 / sqrt(registers))."""
    return 3 * 1.04 / 2 ** (bits / 2)


def eval_rows(qa: DataFrame, split_ids: DataFrame, tail_categories=()) -> DataFrame:
    """Rows of the listed splits plus the tail split.

    A table id listed twice in a split yields its rows twice, like the
    reference's nested loops.
    """
    listed = split_ids.select("split", "table_id")
    if tail_categories:
        tail = table_category(qa).where(F.col("category").isin(*tail_categories))
        listed = listed.unionByName(tail.select(F.lit("tail").alias("split"), "table_id"))
    return listed.join(last_answers(qa), "table_id").select("split", "table_id", "question", "answer")


def train_rows(qa: DataFrame, split_ids: DataFrame, sentinel_table_id=None, exclude_tail: bool = False,
               tail_categories=()) -> DataFrame:
    """Tables not in any listed split, minus the sentinel table.

    ``exclude_tail=False`` keeps the reference's leak: tail tables are not in
    the exclusion list, so they also land in train.
    """
    rows = last_answers(qa).join(split_ids.select("table_id"), "table_id", "left_anti")
    if exclude_tail and tail_categories:
        tail_tables = table_category(qa).where(F.col("category").isin(*tail_categories)).select("table_id")
        rows = rows.join(tail_tables, "table_id", "left_anti")
    if sentinel_table_id is not None:
        if isinstance(sentinel_table_id, DataFrame):
            rows = rows.join(sentinel_table_id.select("table_id"), "table_id", "left_anti")
        else:
            rows = rows.where(F.col("table_id") != F.lit(sentinel_table_id))
    return rows.select("table_id", "question", "answer")


def last_table(qa: DataFrame) -> DataFrame:
    """the table seen last (the reference drops ``tables[:-1]``'s tail);
    one row, so it is safe to broadcast."""
    return qa.groupBy("table_id").agg(F.min("row_id").alias("_first")).agg(
        F.max_by("table_id", F.col("_first")).alias("table_id"))


def overlap(split_ids: DataFrame, a: str = "test", b: str = "dev") -> DataFrame:
    """Table ids listed in both splits."""
    left = split_ids.where(F.col("split") == a).select("table_id")
    right = split_ids.where(F.col("split") == b).select("table_id")
    return left.intersect(right)
