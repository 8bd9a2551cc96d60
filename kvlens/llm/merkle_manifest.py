"""Merkle manifest of a dataset, as a content-addressed store of nodes.

Every document row is a leaf: the digest of its fields, each ``-`` if null, else
its UTF-8 byte count, ``:`` and its value.  Leaves of one language, ascending by
``doc_id`` (null first; repeated ids by digest), form runs of eight; a run's
digest is the parent, until one node is left, the language's subroot.  Subroots,
ordered by language (null first, bytewise), form the upper tree in the same way.

The store holds one record per distinct digest and height: digest -> its
children's digests.  A proof is found from the root: a request for a leaf
descends by the base-8 digits of its rank, looks up the record of the digest it
stands on, takes the child of that digit and keeps the others.  Requests that
share a prefix of digits descend as one row, so all leaves together make n/8 +
n/64 + ... lookups.  The segments met on the way down are reversed at the end,
as a proof reads from the leaf upward.

Ranks come from one range-partitioned sort and the counts per partition, so no
task holds a language.  Digests are kept as 32 bytes and hashed as hex text.

Null fields are leaves as stated; an empty table has no leaves and no root;
repeated rows are leaves of their own (they share store records; joins by digest
are plain equi-joins that adaptive execution splits where one digest is
frequent).  Other columns of ``documents`` are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlens.session import materialise

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _digest(c: Column) -> Column:
    """The 32 bytes of the sha256 of a text."""
    return F.unhex(F.sha2(c, 256))


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a document row, with ``text`` in place of its own text if given."""
    return _digest(F.concat(*[_field(text if text is not None and f == "text" else F.col(f)) for f in FIELDS]))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def tampered() -> Column:
    """Rows whose text the audit changes: 3 divides the crc32 of the decimal id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def _ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0, by ``order`` within ``group``) and ``n`` (rows of the group)."""
    spread = df.withColumn("__row", F.monotonically_increasing_id())  # equal rows go to different partitions too
    keys = [group, *order, "__row"]
    spread = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    rows = materialise(spread.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    # One row per partition and group in it: where the group begins there, and its rows in earlier partitions.
    spans = rows.groupBy(group, "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(group, "part", (before - F.col("begin")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return rows.join(spans, [group, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _heights(n: int | None) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    height = 0
    while (n or 0) > FAN**height:
        height += 1
    return height


def _height(n: Column, most: int) -> Column:
    return sum((F.when(n > FAN**h, 1).otherwise(0) for h in range(most)), F.lit(0))


@dataclass
class Tree:
    """``stores[h - 1]``: the records of height h; ``tops``: group, n, digest of each group's last node."""

    stores: list[DataFrame]
    tops: DataFrame


def _grow(leaves: DataFrame, name: str) -> Tree:
    """The trees over ``leaves`` (grp, n, idx, digest), one for each ``grp``."""
    most = _heights(leaves.agg(F.max("n")).first()[0])
    nodes, stores = leaves, []
    tops = nodes.where("n = 1")
    for h in range(1, most + 1):
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        children = F.unhex(F.array_join(F.transform(run, lambda x: F.hex(x["digest"])), ""))
        made = nodes.where(F.col("n") > FAN ** (h - 1)).groupBy("grp", "n", F.floor(F.col("idx") / FAN).alias("up")).agg(children.alias("children"))
        made = made.withColumns({"digest": _digest(_hex(F.col("children")))}).withColumnRenamed("up", "idx")
        made = materialise(made, f"{name}-{h}")
        stores.append(materialise(made.select("digest", "children").dropDuplicates(["digest"]), f"{name}-store-{h}"))
        nodes = made.select("grp", "n", "idx", "digest")
        tops = tops.unionByName(nodes.where(F.col("n") <= FAN**h))
    return Tree(stores, tops.select("grp", "n", "digest"))


@dataclass
class Manifest:
    """``leaves``: the ranked rows (lang_key, n, rank, leaf, changed, doc_id);
    ``subroots``: lang_key, n, rank among languages, subroot; ``root``: hex, None if empty."""

    leaves: DataFrame
    lower: Tree
    subroots: DataFrame
    upper: Tree
    root: str | None


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs``; ``changed`` is the digest of a tampered row, else null."""
    rows = docs.select(
        "doc_id",
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("lang"))).alias("lang_key"),
        leaf_digest().alias("leaf"),
        F.when(tampered(), leaf_digest(lower_ascii(F.col("text")))).alias("changed"),
    )
    leaves = materialise(_ranked(rows, "lang_key", ["doc_id", "leaf"], "merkle-sorted"), "merkle-leaves")
    lower = _grow(leaves.select(F.col("lang_key").alias("grp"), "n", F.col("rank").alias("idx"), F.col("leaf").alias("digest")), "merkle-low")
    langs = lower.tops.select(F.col("grp").alias("lang_key"), F.col("n").alias("rows"), F.col("digest").alias("subroot"), F.lit("").alias("all"))
    langs = materialise(_ranked(langs, "all", ["lang_key"], "merkle-langs"), "merkle-subroots")
    upper = _grow(langs.select(F.col("all").alias("grp"), "n", F.col("rank").alias("idx"), F.col("subroot").alias("digest")), "merkle-up")
    root = upper.tops.select(_hex(F.col("digest"))).first()
    return Manifest(leaves, lower, langs.select("lang_key", F.col("rows").alias("n"), "rank", "subroot"), upper, root[0] if root else None)


def _segment(children: Column, digit: Column) -> Column:
    """The children left and right of the one chosen."""
    at = (digit * 32).cast("int")
    return F.struct(F.substring(children, F.lit(1), at).alias("left"), F.substring(children, at + 33, F.lit(32 * FAN)).alias("right"))


def _descend(front: DataFrame, store: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """From nodes to their children: looks each digest up and splits by the next digit.
    ``wanted`` (grp, idx) keeps only the children that requests ask for."""
    met = front.join(store, "digest")
    digit = F.explode(F.sequence(F.lit(0), (F.octet_length("children") / 32 - 1).cast("int")))
    met = met.withColumn("digit", digit).withColumn("idx", F.col("idx") * FAN + F.col("digit"))
    if wanted is not None:
        met = met.join(wanted, ["grp", "idx"], "left_semi")
    return met.withColumns(
        {"digest": F.substring("children", (F.col("digit") * 32 + 1).cast("int"), F.lit(32)), "path": F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))}
    ).drop("children", "digit")


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The rows of ``manifest.leaves`` (or of ``requests``, some of them) with
    ``subroot`` and ``path``: the siblings left and right, from the leaf to the root."""
    asked = manifest.leaves if requests is None else requests

    def prefixes(key: Column, rank: str, height: int, src: DataFrame) -> DataFrame | None:
        if requests is None:
            return None
        return src.select(key.alias("grp"), F.floor(F.col(rank) / FAN**height).alias("idx")).distinct()

    no_path = F.array().cast(_PATH)
    top = manifest.upper.tops.select("grp", F.lit(0).cast("long").alias("idx"), "digest", no_path.alias("path"))
    upper_asked = None if requests is None else manifest.subroots.join(asked.select("lang_key").distinct(), "lang_key", "left_semi")
    for h in range(len(manifest.upper.stores), 0, -1):
        top = _descend(top, manifest.upper.stores[h - 1], prefixes(F.lit(""), "rank", h - 1, upper_asked))
    entries = top.select(F.col("idx").alias("rank"), "path").join(manifest.subroots, "rank")
    most = len(manifest.lower.stores)
    entries = entries.select(F.col("lang_key").alias("grp"), F.lit(0).cast("long").alias("idx"), "subroot", F.col("subroot").alias("digest"), "path", _height(F.col("n"), most).alias("height"))

    front = None
    for h in range(most, 0, -1):
        here = entries.where(F.col("height") == h).drop("height")
        front = here if front is None else front.unionByName(here)
        if h > 1:
            front = _descend(front, manifest.lower.stores[h - 1], prefixes(F.col("lang_key"), "rank", h - 1, asked))
    # The last digit is taken beside the leaf, so that a path is sent once for a run of eight.
    last = entries.where("height = 0").select("grp", "idx", "subroot", "path", F.lit(None).cast("binary").alias("children"))
    if front is not None:
        last = last.unionByName(front.join(manifest.lower.stores[0], "digest").drop("digest"))
    last = last.select(F.col("grp").alias("lang_key"), F.col("idx").alias("run"), "subroot", F.col("path").alias("above"), "children")
    met = asked.withColumn("run", F.floor(F.col("rank") / FAN)).join(last, ["lang_key", "run"])
    own = F.when(F.col("children").isNull(), no_path).otherwise(F.array(_segment(F.col("children"), F.col("rank") % FAN)))
    return met.withColumn("path", F.reverse(F.concat("above", own))).drop("run", "above", "children")


def fold(digest: Column, path: Column) -> Column:
    """The root (hex) that a digest and a proof give."""
    return F.aggregate(path, _hex(digest), lambda at, s: F.sha2(F.concat(_hex(s["left"]), at, _hex(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    siblings = F.aggregate(path, F.unhex(F.lit("")), lambda at, s: F.concat(at, s["left"], s["right"]))
    return F.sha2(_hex(siblings), 256)


def audit(docs: DataFrame) -> DataFrame:
    """Every row with its leaf, subroot, root and the digest of its proof; the
    root that its (for some rows tampered) data folds to, and whether that is the root."""
    manifest = build(docs)
    root = F.lit(manifest.root).cast("string")
    found = proofs(manifest)
    out = found.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
