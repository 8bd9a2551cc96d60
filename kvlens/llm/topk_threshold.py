"""Exact top-k by inner product with Fagin's threshold algorithm.

Rows are dealt into blocks of about ``BLOCK`` rows.  A block keeps, for every
dimension, its rows sorted by that component.  A query walks the lists in
parallel (downward where its own component is positive, upward where it is
negative), scores each row that it meets for the first time in full, and
stops when the threshold, the best score that a row not yet met can have, is
below the k-th best score found (a tie could still win by its id, so equality
goes on).  The depth doubles from round to round, so a round is array code.

Queries are a stated set; they meet all rows block by block: a task takes one
block of queries and one block of rows.  A first pass over one block of rows
gives every query a score that its k-th result reaches for certain; the other
blocks start from that score.  The k best of each block are merged per query.

Vectors that are null, of another length than most, or hold null or
non-finite components take no part.  Repeated rows are candidates once each;
a query leaves out every row of its own id.  Ties go to the smaller id.  An
empty table gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, START = 2048, 512, 16


class Lists:
    """The sorted per-dimension lists of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.whole = ids[order], vectors[order], vectors.dtype.kind == "i"
        # Sums of whole numbers below 2**53 are exact in doubles, whose products are faster.
        self.most = int(np.abs(self.rows).max(initial=0)) * self.rows.shape[1]
        up = np.argsort(self.rows, axis=0, kind="stable")  # row numbers, ascending by component
        values = np.take_along_axis(self.rows, up, axis=0).astype(float)
        self.lists = np.stack([up, up[::-1]])  # upward and downward
        self.values = np.stack([values, values[::-1]])
        self.floats = self.rows.astype(float)

    def top(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, if they reach ``floor``."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        way = (query[dims] > 0).astype(int)
        fast = not self.whole or self.most * int(np.abs(query).max(initial=0)) < 2**53
        rows, q = (self.floats, query.astype(float)) if fast else (self.rows, query)
        met, others = np.zeros(n, bool), self.ids != own
        at, scores, begin, stop = np.empty(0, np.int64), np.empty(0, q.dtype), 0, min(START, n) if len(dims) else n
        while True:
            seen = met.copy()
            if stop == n:
                met[:] = True
            else:
                met[self.lists[way, begin:stop, dims].reshape(-1)] = True
            new = np.flatnonzero(met & ~seen & others)
            at, scores = np.concatenate([at, new]), np.concatenate([scores, rows[new] @ q])
            if len(at) > k:
                near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                at, scores = at[near], scores[near]
            if met.all():
                break
            kth = max(floor, scores.min() if len(scores) >= k else -np.inf)
            if (query[dims] * self.values[way, stop - 1, dims]).sum() < kth:
                break
            begin, stop = stop, min(2 * stop, n)
        best = np.lexsort((self.ids[at], -scores))[:k]
        best = best[scores[best] >= floor]
        return self.ids[at[best]], scores[best].astype(query.dtype)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows of largest inner product
    with each query.  ``vector`` holds whole numbers (as longs) or doubles."""

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        return df.select(F.col(vec_id).alias("id"), v.alias("v")).where(F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull()))

    rows, asked = sound(vectors), sound(queries)
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    dims, n_rows = (sizes[0]["dims"], sizes[0]["n"]) if sizes else (0, 0)
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    n_asked = asked.count()
    kind = "long" if dict(rows.dtypes)["v"] in ("array<bigint>", "array<int>") else "double"
    blocks, groups = max(1, -(-n_rows // BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows, asked = rows.withColumn("block", deal(blocks, 1)), asked.withColumn("part", deal(groups, 2))

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            lists = Lists(right["id"].to_numpy(np.int64), np.stack(right["v"].to_numpy()))
            for own, v, floor in zip(left["id"], left["v"], left["floor"]):
                ids, scores = lists.top(np.asarray(v), own, k, floor)
                found.append((own, ids.tolist(), scores.tolist()))
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"])

    made = f"query_id long, ids array<long>, scores array<{kind}>"

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        return some.groupBy("part", "block").cogroup(others.groupBy("part", "block")).applyInPandas(walk, made)

    none = F.lit(float("-inf"))
    # The k-th best of one block of rows: a floor for the whole table.
    seed = met(asked.withColumn("block", F.lit(0)).withColumn("floor", none), rows.where("block = 0").withColumn("part", every(groups)))
    floor = seed.select(F.col("query_id").alias("id"), F.when(F.size("ids") == k, F.element_at("scores", -1).cast("double")).alias("floor")).distinct()
    asked = asked.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", none))
    found = met(asked.withColumn("block", every(blocks)), rows.withColumn("part", every(groups)))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ids, scores = (np.concatenate([np.asarray(x) for x in group[c]]) for c in ("ids", "scores"))
        best = np.lexsort((ids, -scores))[:k]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": ids[best].astype(np.int64), "score": scores[best]})

    found = found.where(F.size("ids") > 0).distinct()  # a query row given twice is one query
    return found.groupBy("query_id").applyInPandas(merge, f"query_id long, rank int, vec_id long, score {kind}")


def whole_numbers(vector: str, scale: int = 1024) -> F.Column:
    """``floor(scale * x)`` of every component as longs; null where the vector is
    null or holds a null or non-finite component."""
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(sound, F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale)))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
