"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct word shingles.  Each of the ``hashes``
permutations of 64-bit values gives two signature values, the least and the
greatest of the permuted set, so half the permutations do.  Bands of ``rows``
values are the buckets; with 25 bands of 5, two sets of similarity 0.85 share no
bucket with a chance below 1e-6, and at 0.8 of about 5e-5.

Links are settled without ever listing all pairs of a bucket:

1. Documents of the same set are one class; only classes go on.
2. Each bucket elects a leader, another one in each round, and its members are
   compared with the leader on full sets.  A class remembers the least leader that
   it reached, so large groups of copies fall to one label in a round or two.
3. Buckets whose members all carry one label are settled.  In what is left, every
   two members of different labels are compared on full sets: as rows where a
   bucket is small, else block by block inside tasks that return links alone.

Connected components of the confirmed links, between the classes' smallest ids, then
name each document's group by its smallest id.  Pairs within one label need no comparison, as they are
connected already; so no link between different groups is lost.

Defined cases: a document of fewer words than a shingle is one shingle, its
whole word sequence; one without words, or with a null text, has an empty set
and links with nothing; rows that share an id are one document, which is near to
all that any of its texts is near to; a row without an id is in no group (null
component, kept).  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlens.session import materialise

from . import textcodes

BANDS, ROWS, ROUNDS = 25, 5, 3
SMALL, BLOCK = 16, 256  # members of a bucket whose pairs may be rows; members of a block of a larger one


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, size * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(size):
        h = textcodes.mix(h ^ words[i : n - size + 1 + i])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(991)
    n = -(-bands * rows // 2)
    return rng.integers(0, 2**64, (n, 1), dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, (n, 1), dtype=np.uint64)


def bands_of(s: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of a set, one for each band."""
    least, most = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(s), 4096):
        p = a * s[i : i + 4096] + b
        least, most = np.minimum(least, p.min(1)), np.maximum(most, p.max(1))
    signature = np.column_stack([least, most]).reshape(-1)[: bands * rows].reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = textcodes.mix(key ^ signature[:, i])
    return key.view(np.int64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``id, same, set``: the shingle hashes of each document, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textcodes.slices(whole, "text") if whole.num_rows else ():
                words, first = textcodes.hashed_words(b.column("text"))
                found = [shingles(words[i:j], k).view(np.int64) for i, j in zip(first, first[1:])]
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found)))
                same = pa.array([digest(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), same, sets], names=["id", "same", "set"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, same binary, set array<long>")


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``id, n, same (a digest of the set), bands``."""
    a, b = permutations(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in textcodes.slices(whole, "text") if whole.num_rows else ():
                words, first = textcodes.hashed_words(part.column("text"))
                sets = [shingles(words[i:j], k) for i, j in zip(first, first[1:])]
                keys = [bands_of(s, a, b, bands, rows) if len(s) else np.empty(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "same", "bands"],
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, same binary, bands array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``id, root``: the smallest id reachable over ``a, b`` (a < b), for ids in an edge.

    Each step links every neighbour of a node that is larger than the node to
    its smallest neighbour, then every neighbour not larger, until nothing moves
    (large-star and small-star); hubs shrink to their root's star."""
    edges = materialise(edges.distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = materialise(large, name)  # x > y
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        small = small.select("x", F.col("m").alias("y")).union(small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))).distinct()
        small = materialise(small.select(F.col("y").alias("a"), F.col("x").alias("b")), name)
        same = edges.count() == small.count() and edges.join(small, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if same:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b`` those with ``100 * intersection >= percent * union`` on full sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("i", common).where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(n: str, m: str, percent: int):
    """Sizes that can reach the threshold: the smaller set is at least so large."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    seen = materialise(_signatures(docs, k, bands, rows), "minhash")
    classes = seen.where("n > 0 and id is not null").groupBy("same").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    buckets = materialise(buckets.join(shared, "bucket"), "minhash-buckets")
    wanted = classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "same", F.col("least").alias("id"))
    # A class's set is computed from the rows of its smallest id, and is the one of its digest.
    found = _sets(docs.join(wanted.select("id").distinct(), "id", "left_semi"), k).join(wanted, ["id", "same"])
    sets = materialise(found.groupBy(F.col("rep").alias("id")).agg(F.min("set").alias("set")), "minhash-sets")

    labels = materialise(wanted.select(F.col("rep").alias("id"), F.col("rep").alias("label")), "minhash-labels")
    links = tried = None
    for turn in range(ROUNDS):
        now = buckets.join(labels.withColumnRenamed("id", "rep"), "rep")
        order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
        lead = now.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "label"), order).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        pairs = now.join(lead, "bucket").where((F.col("label") != F.col("lead.label")) & _fits("n", "lead.n", percent))
        pairs = pairs.select(*_pair("rep", "lead.rep")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "minhash-pairs")
        good = materialise(_confirmed(pairs, sets, percent), "minhash-links")
        links, tried = (good, pairs) if links is None else (links.unionByName(good), tried.unionByName(pairs))
        labels = _relabelled(labels, good)
    now = buckets.join(labels.withColumnRenamed("id", "rep"), "rep")
    open_ = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("bucket", "m")
    now = materialise(now.join(open_, "bucket"), "minhash-open")
    few = now.where(F.col("m") <= SMALL)
    one, two = few.alias("one"), few.alias("two")
    rest = one.join(two, (F.col("one.bucket") == F.col("two.bucket")) & (F.col("one.rep") < F.col("two.rep")) & (F.col("one.label") != F.col("two.label")) & _fits("one.n", "two.n", percent))
    rest = rest.select(F.col("one.rep").alias("a"), F.col("two.rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    good = materialise(_confirmed(materialise(rest, "minhash-rest"), sets, percent), "minhash-links")
    more = materialise(_blockwise(now.where(F.col("m") > SMALL), sets, percent), "minhash-links")
    links = links.unionByName(good).unionByName(more)
    roots = components(_id_links(links, classes, seen), "minhash-graph")

    named = classes.select("same", "least").join(roots.withColumnRenamed("id", "least"), "least", "left").select("same", F.coalesce("root", "least").alias("root"))
    found = seen.select("id", "n", "same").join(named, "same", "left")
    root = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    found = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _id_links(links: DataFrame, classes: DataFrame, seen: DataFrame) -> DataFrame:
    """The links of classes as ``a, b`` (a < b) of their smallest ids, and the links
    that ids standing on rows of different sets make."""
    name = classes.select("rep", "least")
    between = links.join(name.select(F.col("rep").alias("a"), F.col("least").alias("x")), "a").join(name.select(F.col("rep").alias("b"), F.col("least").alias("y")), "b")
    own = seen.where("n > 0 and id is not null").select("id", "same")
    several = own.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("id")
    across = own.join(several, "id", "left_semi").distinct().join(classes.select("same", "least"), "same").select(F.col("id").alias("x"), F.col("least").alias("y"))
    return between.select("x", "y").unionByName(across).where("x <> y").select(*_pair("x", "y"))


def _blockwise(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels in large buckets (``bucket, rep, label, m``):
    a bucket is dealt into blocks of about ``BLOCK`` members, and a task compares the full
    sets of one block with those of another, so that no pair is ever a row."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "rep", "label", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.join(sets.withColumnRenamed("id", "rep"), "rep")
    kind = members.schema["rep"].dataType.simpleString()

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep", ignore_index=True)
        size = np.array([len(s) for s in g["set"]])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        _, member = np.unique(np.concatenate(g["set"].to_numpy()), return_inverse=True)
        rep, mine, whole = g["rep"].tolist(), g["mine"].to_numpy(), bool(g["i"].iloc[0] == g["j"].iloc[0])
        label, found = g["label"].to_numpy().copy(), []
        here = np.zeros(member.max() + 1, bool)
        for k in range(len(g) - 1):
            own = member[at[k] : at[k] + size[k]]
            here[own] = True
            common = np.add.reduceat(here[member[at[k + 1] :]], at[k + 1 :] - at[k + 1], dtype=np.int64)
            here[own] = False
            near = 100 * common >= percent * (size[k] + size[k + 1 :] - common)
            if not whole:
                near &= mine[k + 1 :] != mine[k]
            for x in k + 1 + np.flatnonzero(near):
                if label[x] != label[k]:  # else connected already
                    found.append((rep[k], rep[x]))
                    label[label == label[x]] = label[k]
        return pd.DataFrame(found, columns=["a", "b"]).astype(g["rep"].dtype)

    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _relabelled(labels: DataFrame, good: DataFrame) -> DataFrame:
    """The least label that each id reaches over one link, then over that label's own id."""
    both = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
    one = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
    one = materialise(one, "minhash-labels")
    up = one.select(F.col("id").alias("label"), F.col("label").alias("up"))
    return materialise(one.join(up, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label")), "minhash-labels")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
