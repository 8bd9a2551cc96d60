"""Resuming partly finished runs.

The reference restarts at ``len(done)`` (by position, and two scripts
restart at 0 by mistake).  Here the rows still to do are found by key with
a left anti join, which is order-free and safe to repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def pending(todo: DataFrame, done: DataFrame, keys=("table_id", "question")) -> DataFrame:
    """Rows of ``todo`` whose key has no result in ``done``."""
    return todo.join(done.select(*keys).dropDuplicates(), list(keys), "left_anti")


def successful(results: DataFrame, col: str = "predicted_answer") -> DataFrame:
    """results that are not the retry-exhausted sentinel (so a resume
    retries them)."""
    return results.where(F.col(col).isNotNull() & ~F.col(col).isin(*P.FAILED_SENTINELS))
