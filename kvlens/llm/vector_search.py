"""Approximate nearest neighbours from several shifted Hilbert orderings.

Inner product becomes nearness: every vector gets one more component,
``sqrt(largest norm^2 - norm^2)``, and queries a zero there, so that the row
of the largest inner product is the nearest row.  Each of ``ORDERINGS`` curves
takes ``DIMS`` orthonormal random projections of that vector, shifts them by a
random offset, and visits them in the order of a Hilbert curve.

Spark range-partitions the rows by (ordering, key); a partition is a window of
the curve (queries are placed among the rows), so each ordering is cut into about ``windows`` equal windows, more as
the table grows so that a window holds at most ``WINDOW_ROWS`` rows.  A query meets, in every
ordering, the rows of its own window and of ``reach`` windows on both sides;
they are scored exactly on the original vectors, in double precision, and the
windows' best merge into the query's best.

``reach`` is fitted: the exact neighbours of ``SAMPLE`` queries (smallest hashes of
their ids) are found by brute force, and the smallest reach with which
``target`` of them are met is taken.  Vectors with structure need one
window or two; vectors that spread evenly in many dimensions need a wide reach,
as no ordering of a line can hold their neighbours close.

Vectors that are null, of another length than most, zero, or hold null or
non-finite components take no part.  Repeated rows count once; a query leaves
out every row of its own id.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlens.session import materialise

ORDERINGS, DIMS, BITS = 8, 4, 12
WINDOWS, WINDOW_ROWS, SAMPLE = 32, 65_536, 64


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below ``2**bits``
    (Skilling's transform, then the bits interleaved)."""
    x = [c.astype(np.uint64) for c in cells.T]
    one, n = np.uint64(1), len(x)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
        q >>= one
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | (((c ^ t) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Curves:
    """The fitted orderings: what a task needs to key vectors."""

    def __init__(self, dims: int, norm: float, seed: int):
        rng = np.random.default_rng(seed)
        self.norm = norm
        per = max(1, min(DIMS, dims + 1))
        self.axes = []
        for _ in range(ORDERINGS):
            self.axes.append(np.linalg.qr(rng.normal(size=(dims + 1, per)))[0])
        #: A projection of a vector of the largest norm spreads by about norm / sqrt(dims).
        self.scale = norm * 4 / np.sqrt(dims + 1)
        self.shift = rng.random((ORDERINGS, per)) * 0.25

    def keys(self, x: np.ndarray, asked: np.ndarray) -> np.ndarray:
        more = np.where(asked, 0, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0)))
        x = np.column_stack([x, more])
        out = []
        for axes, shift in zip(self.axes, self.shift):
            y = (x @ axes / self.scale + 1) / 2 * 0.75 + shift
            out.append(hilbert_key(np.clip(y * (1 << BITS), 0, (1 << BITS) - 1), BITS))
        return np.column_stack(out)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding",
    target: float = 0.95, windows: int = WINDOWS, seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product found for each query."""
    spark, out = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"

    def sound(df: DataFrame, asked: bool) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(asked).alias("asked"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))

    rows, asked = sound(vectors, False), sound(queries, True).dropDuplicates(["id"])
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("most"))
    facts = facts.orderBy(F.desc("n"), "dims").limit(1).collect()
    if not facts:
        return spark.createDataFrame([], out)
    dims, n = facts[0]["dims"], facts[0]["n"]
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    curves = Curves(dims, float(np.sqrt(facts[0]["most"])), seed)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "v", "asked", *(f"k{i}" for i in range(ORDERINGS))]
        for b in batches:
            if b.num_rows:
                keys = curves.keys(matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in keys.T)], names=names)

    kind = dict(rows.dtypes)["v"]
    both = rows.unionByName(asked).mapInArrow(keyed, f"id long, v {kind}, asked boolean, " + ", ".join(f"k{i} long" for i in range(ORDERINGS)))
    each = F.array(*(F.struct(F.lit(i).alias("o"), F.col(f"k{i}").alias("key")) for i in range(ORDERINGS)))
    both = both.select("id", "v", "asked", F.explode(each).alias("at")).select("id", "v", "asked", "at.o", "at.key")
    cut = ORDERINGS * max(windows, -(-n // WINDOW_ROWS))
    both = materialise(both.repartitionByRange(cut, "o", "key", "id").withColumn("w", F.spark_partition_id()), "windows")
    dealt, chosen = both.where("not asked").select("id", "v", "o", "w"), both.where("asked").select("id", "v", "o", "w")
    reach = _fit_reach(rows, asked, dealt, chosen, k, target)

    def score(asked_part: pd.DataFrame, rows_part: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked_part) and len(rows_part):
            ids, x = rows_part["id"].to_numpy(np.int64), np.stack(rows_part["v"].to_numpy()).astype(np.float64)
            for at in range(0, len(asked_part), 64):
                some = asked_part.iloc[at : at + 64]
                for own, s in zip(some["id"], np.stack(some["v"].to_numpy()).astype(np.float64) @ x.T):
                    b = top(own, ids, s, k)
                    found.append((own, ids[b].tolist(), s[b].tolist()))
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ids, scores = (np.concatenate([np.asarray(x) for x in group[c]]) for c in ("ids", "scores"))
        ids, first = np.unique(ids, return_index=True)
        b = best(ids, scores[first], k)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(b) + 1, dtype=np.int32), "vec_id": ids[b].astype(np.int64), "score": scores[first][b].astype(np.float64)})

    spread = F.explode(F.sequence(F.col("w") - reach, F.col("w") + reach))
    met = chosen.select("id", "v", spread.alias("w")).groupBy("w").cogroup(dealt.select("id", "v", "w").groupBy("w"))
    found = met.applyInPandas(score, "query_id long, ids array<long>, scores array<double>").where(F.size("ids") > 0)
    return found.groupBy("query_id").applyInPandas(merge, out)


def top(own: int, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """``best`` over the rows of other ids."""
    others = np.flatnonzero(ids != own)
    return others[best(ids[others], scores[others], k)]


def _fit_reach(rows: DataFrame, asked: DataFrame, dealt: DataFrame, chosen: DataFrame, k: int, target: float) -> int:
    """Smallest reach that meets ``target`` of the exact neighbours of the sample."""
    sample = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").collect()
    if not sample:
        return 0
    own = np.array([r["id"] for r in sample])
    x = np.array([list(r["v"]) for r in sample], np.float64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in own]
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                for i, s in enumerate(x @ matrix(b.column(1)).T):
                    t = top(own[i], ids, s, k)
                    both = np.concatenate([kept[i][0], ids[t]]), np.concatenate([kept[i][1], s[t]])
                    t = best(*both, k)
                    kept[i] = both[0][t], both[1][t]
        cols = [np.repeat(own, [len(i) for i, _ in kept]), *(np.concatenate(c) for c in zip(*kept))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "id", "score"])

    found = rows.select("id", "v").mapInArrow(exact, "q long, id long, score double").dropDuplicates(["q", "id"])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = F.broadcast(found.withColumn("r", place).where(F.col("r") <= k).select("q", "id"))  # k rows for each of the sample
    at = dealt.select("id", "o", F.col("w").alias("there")).join(found, "id")
    here = F.broadcast(chosen.where(F.col("id").isin([int(i) for i in own])).select(F.col("id").alias("q"), "o", "w"))
    far = at.join(here, ["q", "o"]).groupBy("q", "id").agg(F.min(F.abs(F.col("there") - F.col("w"))).alias("far"))
    far = sorted(r["far"] for r in far.collect())
    return int(far[min(len(far) - 1, int(np.ceil(target * len(far))) - 1)]) if far else 0


cloudpickle.register_pickle_by_value(sys.modules[__name__])
