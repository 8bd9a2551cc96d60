"""Lloyd's clustering with heap-ordered bounds, exact in whole numbers.

A vector's gap is a lower bound of its distance to every other centroid less an
upper bound of the distance to its own.  When centroids move, the gap shrinks by
at most the drift of the own centroid and the largest drift of the others.  That
loss is the same for all vectors of a cluster, so each cluster adds it up once
and keeps its vectors in a heap by ``gap + loss so far``: as long as a vector's
key lies above the cluster's loss, its cluster is certain.  Each round pops only
the vectors whose gap expired, measures them against every centroid and pushes
them back; the sums of the clusters change by the vectors that moved.

The heaps are split by blocks of vectors, so a cluster of any size is worked on
everywhere.  A block's heap of one cluster is an array in ascending order (which
is a heap): pops are its prefix.  Vectors are written once, as blocks in a table
bucketed by block; the heaps of a round are a table in the same buckets, so a
round joins both without a shuffle, and a lost task only reads its bucket again.
Through the driver go centroids and sums (``k`` x dimensions).

Bounds are kept in doubles with a margin for rounding, so a vector too many may be
measured, never one too few; distances and means are whole numbers.

Vectors that are null, of another length, or hold null or non-finite components
take no part; nor do components beyond 2**27, whose squared distances have no
long.  Repeated rows are vectors of their own; equal hashes of an id start by the
smaller vector, null ids last.  With fewer vectors than ``k`` there are as many
centroids as vectors; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.session import ensure_checkpoint_dir, materialise

BLOCK_BYTES, BUCKET_BLOCKS, LIMIT, SLACK = 2 << 20, 8, 1 << 27, 1e-9


def whole_vectors(df: DataFrame, vector: str, vec_id: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of the sound vectors of ``dims`` components."""
    v = F.col(vector)
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LIMIT))
    return df.where(v.isNotNull() & sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector."""
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass
class Heaps:
    """The heaps of one block: rows and keys, cluster by cluster, ascending by key.

    ``starts[c] : starts[c + 1]`` is the heap of cluster c.
    """

    rows: np.ndarray
    keys: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, clusters: np.ndarray, keys: np.ndarray, k: int) -> Heaps:
        order = np.lexsort((keys, clusters))
        return cls(rows[order].astype(np.int32), keys[order], np.searchsorted(clusters[order], np.arange(k + 1)).astype(np.int32))

    @classmethod
    def unpack(cls, data: bytes, n: int) -> Heaps:
        return cls(np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float64, n, 4 * n), np.frombuffer(data, np.int32, -1, 12 * n))

    def pack(self) -> bytes:
        return self.rows.tobytes() + self.keys.tobytes() + self.starts.tobytes()

    def clusters(self) -> np.ndarray:
        """Cluster of every entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def pop(self, losses: np.ndarray) -> np.ndarray:
        """Entries whose gap expired: of each heap the prefix up to its loss."""
        ends = [a + np.searchsorted(self.keys[a:z], loss, "right") for a, z, loss in zip(self.starts[:-1], self.starts[1:], losses)]
        out = np.zeros(len(self.rows), bool)
        for a, e in zip(self.starts[:-1], ends):
            out[a:e] = True
        return out


def measure(vectors: np.ndarray, centroids: np.ndarray, losses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and heap key of each vector."""
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0)
    d = squared(vectors, centroids)
    own = d.argmin(axis=1)
    near = np.sqrt(d[np.arange(len(d)), own].astype(float))
    d[np.arange(len(d)), own] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1).astype(float)) if len(centroids) > 1 else np.full(len(d), np.inf)
    return own, other - near - SLACK * (1 + near + np.where(np.isinf(other), 0, other) + losses[own]) + losses[own]


def round_of(vectors: np.ndarray, state: bytes | None, centroids: np.ndarray, losses: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, int]:
    """One round over a block: its heaps, the change of sums and counts, vectors measured."""
    k, dims = centroids.shape
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    if state is None:
        rows = np.arange(len(vectors))
        own, keys = measure(vectors, centroids, losses)
        np.add.at(sums, own, vectors)
        return Heaps.of(rows, own, keys, k), sums, counts + np.bincount(own, minlength=k), len(rows)
    heaps = Heaps.unpack(state, len(vectors))
    expired = heaps.pop(losses)
    if not expired.any():
        return heaps, sums, counts, 0
    rows, before = heaps.rows[expired], heaps.clusters()
    own, keys = measure(vectors[rows].astype(np.int64), centroids, losses)
    moved = own != before[expired]
    np.add.at(sums, own[moved], vectors[rows[moved]])
    np.subtract.at(sums, before[expired][moved], vectors[rows[moved]])
    counts += np.bincount(own[moved], minlength=k) - np.bincount(before[expired][moved], minlength=k)
    before[expired] = own
    all_keys = heaps.keys.copy()
    all_keys[expired] = keys
    return Heaps.of(heaps.rows, before, all_keys, k), sums, counts, len(rows)


class Scratch:
    """Tables in the shared folder, bucketed by ``block``; dropped at the end."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.mark = spark, buckets, uuid.uuid4().hex
        self.folder = ensure_checkpoint_dir(spark).rstrip("/")
        self.names: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        table = f"kvlens_{name}_{self.mark}"
        df.write.format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.folder}/{table}").saveAsTable(table)
        self.names.append(name)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Removes a table and its files."""
        table = f"kvlens_{name}_{self.mark}"
        self.names.remove(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors as blocks: ids, and the components as 32-bit numbers row by row."""
    rows_of = max(1, BLOCK_BYTES // (4 * dims))
    kind = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, rows_of):
                part = batch.slice(i, rows_of)
                data = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], schema=kind)
                number += 1

    return vectors.mapInArrow(run, "block long, ids array<long>, vectors binary")


def _start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest sha256 of ``seed:vec_id``."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What each cluster's gaps lose when centroids move: own drift and the largest other."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float))
    loss = moved + [np.delete(moved, c).max(initial=0.0) for c in range(len(moved))]
    return loss * (1 + SLACK)


@dataclass
class Clustering:
    """``centroids`` in order, ``counts`` of vectors measured per round, and the rows
    ``vec_id, cluster, distance`` (squared)."""

    centroids: np.ndarray
    measured: list[int]
    rows: DataFrame


def cluster(df: DataFrame, k: int, rounds: int, dims: int, scale: int = 1024, seed: int = 3, vector: str = "embedding", vec_id: str = "vec_id") -> Clustering:
    """``rounds`` of assignment and update (componentwise floor of the mean; an empty
    cluster keeps its centroid), then a last assignment."""
    spark = df.sparkSession
    vectors = whole_vectors(df, vector, vec_id, dims, scale)
    centroids = _start(vectors, k, seed)
    if not len(centroids):
        return Clustering(np.zeros((0, dims), np.int64), [], vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    k = len(centroids)
    n_blocks = -(-vectors.count() * 4 * dims // BLOCK_BYTES)
    scratch = Scratch(spark, min(10_000, max(8, n_blocks // BUCKET_BLOCKS)))
    blocks = scratch.put(_blocks(vectors, dims).repartition(scratch.buckets, "block"), "blocks")
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    losses, state, measured = np.zeros(k), None, []
    for n in range(rounds):
        state = scratch.put(_round(blocks, state, centroids, losses), f"heaps{n}")
        if n:
            scratch.drop(f"heaps{n - 1}")
        changes = _changes(state, k, dims)
        measured.append(changes.pop("measured"))
        for c, (count, change) in changes.items():
            counts[c] += count
            sums[c] = [a + b for a, b in zip(sums[c], change)]
        moved = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)], np.int64)
        losses, same = losses + _drift(centroids, moved), (moved == centroids).all()
        centroids = moved
        if same:  # nothing moves any more
            break
    rows = materialise(_assign(_paired(blocks, state), centroids, losses), "clusters")
    for name in list(scratch.names):
        scratch.drop(name)
    return Clustering(centroids, measured, rows)


def _paired(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return blocks.withColumn("heaps", F.lit(None).cast("binary"))
    return blocks.join(state.select("block", "heaps"), "block")


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, losses: np.ndarray) -> DataFrame:
    """The heaps after one assignment; with each block what it changes in the sums."""
    k, dims = centroids.shape
    kind = pa.schema([("block", pa.int64()), ("heaps", pa.binary()), ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("measured", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, heaps = batch.column("vectors")[i].as_py(), batch.column("heaps")[i].as_py()
                made, sums, counts, n = round_of(np.frombuffer(data, "<i4").reshape(-1, dims), heaps, centroids, losses)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(i, 1), pa.array([made.pack()], pa.binary()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], schema=kind
                )

    return _paired(blocks, state).select("block", "vectors", "heaps").mapInArrow(run, "block long, heaps binary, sums array<long>, counts array<long>, measured long")


def _changes(state: DataFrame, k: int, dims: int) -> dict:
    """Sums over all blocks: cluster -> (count, components), and the vectors measured."""
    each = state.select("measured", F.posexplode(F.concat("sums", "counts")))
    found = each.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"), F.sum("measured").alias("measured")).collect()
    total = {r["pos"]: int(r["total"]) for r in found}
    out: dict = {c: (total[k * dims + c], [total[c * dims + d] for d in range(dims)]) for c in range(k)}
    return out | {"measured": found[0]["measured"]}


def _assign(paired: DataFrame, centroids: np.ndarray, losses: np.ndarray) -> DataFrame:
    """The last assignment: cluster and exact squared distance of every vector."""
    k, dims = centroids.shape
    kind = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(-1, dims)
                heaps, *_ = round_of(vectors, batch.column("heaps")[i].as_py(), centroids, losses)
                own = np.empty(len(vectors), np.int32)
                own[heaps.rows] = heaps.clusters()
                distance = ((vectors - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(own), pa.array(distance)], schema=kind)

    return paired.select("ids", "vectors", "heaps").mapInArrow(run, "vec_id long, cluster int, distance long")


def with_inertia(found: Clustering) -> DataFrame:
    """``vec_id, cluster, distance`` with the distance summed over the cluster and over
    all (at most the largest long), and the sha256 of the final centroid."""
    spark = found.rows.sparkSession
    rows = found.rows
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in found.centroids]
    most, total = 2**63 - 1, sum(sums.values())
    table = [(c, min(sums.get(c, 0), most), min(total, most), d) for c, d in enumerate(digests)]
    per = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
