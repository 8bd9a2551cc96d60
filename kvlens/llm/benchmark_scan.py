"""Benchmark decontamination with Wu and Manber's multi-pattern search over words.

A word is a run of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased.  The test strings are the windows of ``WINDOW`` consecutive words of
the benchmark items; an item of fewer words is one window.  Windows of one
length are searched together:

* the shift table holds for every block of two words (by hash) how far a window's
  end may move when the block stands there; blocks of no window shift by the
  window's length less one, so most words are never looked at;
* where the shift is zero, the block's hash selects the bucket of the windows that
  end with it, in which the entries stand ordered by a hash of the whole window;
* the words of the entries found are compared byte by byte with the text.

Texts are cut into lanes of ``LANE`` window ends that step together as array code;
a lane looks back over its start, so cuts lose nothing.

Items are dealt by hash into blocks of about ``BLOCK_BYTES`` of windows' words (long
items in pieces that overlap by ``WINDOW - 1`` words), and a block's tables are
broadcast: one scan of the texts for a block, whatever the benchmark's size.  The
usual benchmark is one block and needs no shuffle at all.  With more, the rows hit
are joined by (id, digest of the text), which equal rows share.

Null and empty texts have no words and no hits.  Items of a null id count as hits,
but not as items; repeated item ids are one item; repeated documents are answered
row by row.  Without items or documents nothing is hit, or there are no rows.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlens.session import materialise

from . import textcodes

WINDOW, LANE, BLOCK_BYTES, PIECE, SLICE, PAIRS = 10, 64, 4 << 20, 4096, 1 << 20, 1 << 15

_APART = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _APART[_first : _last + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a run of texts: where they are, and their hashes."""

    def __init__(self, texts: pa.Array):
        self.data, offs = textcodes.buffers(texts)
        self.begins, self.ends, self.first = textcodes.word_spans(self.data, offs, _APART)
        self.hashes = textcodes.word_hashes(self.data, self.begins, self.ends)

    def block(self, last: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words that end with the words ``last``."""
        h = self.hashes[last]
        return h if size == 1 else textcodes.mix(self.hashes[last - 1] * _STEP + h)

    def window(self, last: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(last), np.uint64)
        for back in range(length - 1, -1, -1):
            h = h * _STEP + self.hashes[last - back]
        return textcodes.mix(h)


def same_words(a: Words, at: np.ndarray, b: Words, to: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` words that end at ``a[at]`` and ``b[to]`` are equal bytes."""
    if len(at) > PAIRS:
        cuts = range(0, len(at), PAIRS)
        return np.concatenate([same_words(a, at[i : i + PAIRS], b, to[i : i + PAIRS], length) for i in cuts])
    out = np.ones(len(at), bool)
    for back in range(length):
        live = np.flatnonzero(out)
        i, j = at[live] - back, to[live] - back
        size = a.ends[i] - a.begins[i]
        equal = size == b.ends[j] - b.begins[j]
        out[live[~equal]] = False
        live, i, j, size = live[equal], i[equal], j[equal], size[equal]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x = _LOWER[a.data[np.repeat(a.begins[i], size) + inside]]
        y = _LOWER[b.data[np.repeat(b.begins[j], size) + inside]]
        out[live[np.repeat(np.arange(len(live)), size)[x != y]]] = False
    return out


class Table:
    """Shift table and suffix buckets of the windows of one length.

    ``last`` are the words of ``words`` that end a window, ``owner`` their items.
    """

    def __init__(self, words: Words, last: np.ndarray, owner: np.ndarray, length: int):
        self.words, self.length, self.size = words, length, min(2, length)
        self.most = length - self.size + 1
        # Equal windows are one entry; entries that only share the hash stay apart.
        whole, suffix = words.window(last, length), words.block(last, self.size)
        order = np.lexsort((owner, whole, suffix))
        last, owner, whole, suffix = last[order], owner[order], whole[order], suffix[order]
        new = np.ones(len(last), bool)
        alike = 1 + np.flatnonzero((whole[1:] == whole[:-1]) & (suffix[1:] == suffix[:-1]))
        new[alike] = ~same_words(words, last[alike], words, last[alike - 1], length)
        starts = np.flatnonzero(new)
        self.last, self.whole, suffix = last[starts], whole[starts], suffix[starts]
        self.owner, self.owned = owner, np.append(starts, len(owner))
        self.suffix, self.bucket = np.unique(suffix, return_index=True)
        self.bucket = np.append(self.bucket, len(suffix))
        # Blocks that share a cell share the least shift.
        self.bits = max(12, int(8 * len(starts)).bit_length())
        self.shifts = np.full(1 << self.bits, self.most, np.uint8)
        for back in range(self.most):
            np.minimum.at(self.shifts, self.cell(words.block(self.last - back, self.size)), back)

    def cell(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """All (last word in the text, entry) whose words are equal."""
        n = np.diff(text.first)
        doc = np.flatnonzero(n >= self.length)
        lanes = -(-(n[doc] - self.length + 1) // LANE)
        lane_doc = np.repeat(doc, lanes)
        nth = np.arange(len(lane_doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = text.first[lane_doc] + self.length - 1 + nth * LANE  # word that ends the window, per lane
        stop = np.minimum(at + LANE, text.first[lane_doc + 1])
        ends, entries = [], []
        while len(at):
            block = text.block(at, self.size)
            shift = self.shifts[self.cell(block)].astype(np.int64)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                e, entry = self.select(text, at[hit], block[hit])
                ends.append(e)
                entries.append(entry)
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ends), np.concatenate(entries)

    def select(self, text: Words, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket by suffix, entries in it by the hash of the window, then the bytes."""
        b = np.minimum(np.searchsorted(self.suffix, block), len(self.suffix) - 1)
        known = self.suffix[b] == block
        at, b = at[known], b[known]
        want = text.window(at, self.length)
        lo, hi = self.bucket[b].copy(), self.bucket[b + 1].copy()
        while (open_ := lo < hi).any():  # binary search within each bucket
            mid = (lo + hi) // 2
            less = open_ & (self.whole[np.minimum(mid, len(self.whole) - 1)] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stop = self.bucket[b + 1]
        while True:  # entries of one hash: one, but for collisions
            live = lo < stop
            at, want, lo, stop = at[live], want[live], lo[live], stop[live]
            live = self.whole[lo] == want
            at, want, lo, stop = at[live], want[live], lo[live], stop[live]
            if not len(at):
                return np.concatenate(found_at), np.concatenate(found)
            equal = same_words(text, at, self.words, self.last[lo], self.length)
            found_at.append(at[equal])
            found.append(lo[equal])
            lo = lo + 1


class Patterns:
    """All tables of one block of items."""

    def __init__(self, texts: list[str], ids: list[str | None]):
        self.words = Words(pa.array(texts, pa.string()))
        self.ids = ids
        n = np.diff(self.words.first)
        self.tables = []
        for length in range(1, WINDOW + 1):
            items = np.flatnonzero(n == length if length < WINDOW else n >= length)
            if not len(items):
                continue
            windows = n[items] - length + 1
            owner = np.repeat(items, windows)
            last = self.words.first[owner] + length - 1 + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            self.tables.append(Table(self.words, last, owner, length))
        # Entries of the same items name one set of items.
        self.sets, self.set_of, known = [], [], {}
        for t in self.tables:
            of = np.empty(len(t.last), np.int64)
            for e in range(len(t.last)):
                key = tuple(sorted({ids[i] for i in t.owner[t.owned[e] : t.owned[e + 1]] if ids[i] is not None}))
                if key not in known:
                    known[key] = len(self.sets)
                    self.sets.append(key)
                of[e] = known[key]
            self.set_of.append(of)

    def scan(self, text: Words) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Which words are hit, and the item sets met per text."""
        change = np.zeros(len(text.begins) + 1, np.int64)
        docs, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, of in zip(self.tables, self.set_of):
            last, entry = t.find(text)
            np.add.at(change, last - t.length + 1, 1)
            np.add.at(change, last + 1, -1)
            docs.append(np.searchsorted(text.first, last, "right") - 1)
            sets.append(of[entry])
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(sets)]), axis=1)
        cuts = np.searchsorted(pairs[0], np.arange(len(text.first)))
        return np.cumsum(change[:-1]) > 0, [tuple(pairs[1, a:z].tolist()) for a, z in zip(cuts[:-1], cuts[1:])]


_SCAN = "doc_id long, digest string, n_words long, n_hit long, hits binary, items array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])


def _scan(docs: DataFrame, patterns, with_digest: bool) -> DataFrame:
    """Per row: words, words hit (with a bit per word, null if none), the items met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcodes.slices(batch, "text", SLICE):
                texts = part.column("text")
                words = Words(texts)
                hit, sets = patterns.value.scan(words)
                before = np.append(0, np.cumsum(hit))
                n_hit = before[words.first[1:]] - before[words.first[:-1]]
                bits = [np.packbits(hit[a:z]).tobytes() if n else None for a, z, n in zip(words.first[:-1], words.first[1:], n_hit)]
                named = {m: sorted({x for s in m for x in patterns.value.sets[s]}) for m in set(sets)}
                digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts.to_pylist()] if with_digest else [None] * len(texts)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(digests, pa.string()), pa.array(np.diff(words.first)), pa.array(n_hit)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary()), pa.array([named[m] for m in sets], pa.list_(pa.string()))], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _SCAN)


def _pieces(items: DataFrame) -> DataFrame:
    """Items as runs of at most ``PIECE`` words, each with the first words of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcodes.slices(batch, "text", SLICE):
                words, out = Words(part.column("text")), []
                for name, a, z in zip(part.column("item_id").to_pylist(), words.first[:-1], words.first[1:]):
                    for i in range(a, max(z - WINDOW + 1, a + 1) if z > a else a, PIECE):
                        j = min(i + PIECE + WINDOW - 1, z)
                        out.append((name, b" ".join(words.data[b:e].tobytes() for b, e in zip(words.begins[i:j], words.ends[i:j])).decode()))
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([x[0] for x in out], pa.string()), "piece": pa.array([x[1] for x in out], pa.string())})

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, piece string").distinct()


def find_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, hits`` (a bit per word, the first in the highest bit of
    the first byte; null if none) and ``items`` (ids as sorted strings) of every row of ``docs``."""
    spark = docs.sparkSession
    pieces = materialise(_pieces(items), "benchmark-pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)))
    scans = []
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).collect()  # about block_bytes
        patterns = spark.sparkContext.broadcast(Patterns([r["piece"] for r in rows], [r["item_id"] for r in rows]))
        scans.append(_scan(docs, patterns, blocks > 1))
    if blocks == 1:
        return scans[0].drop("digest")
    base = materialise(scans[0], "benchmark-scan")
    found = base.where("n_hit > 0").select("digest", "hits", "items")
    for scan in scans[1:]:
        found = found.unionByName(scan.where("n_hit > 0").select("digest", "hits", "items"))
    found = materialise(_merged(found.dropDuplicates().groupBy("digest").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))), "benchmark-hits")
    met = base.select("doc_id", "digest", "n_words").join(found, "digest", "left").drop("digest")
    return met.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def _merged(found: DataFrame) -> DataFrame:
    """The words and items that any block met, one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bits = np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in r["hits"]])
                out.append({"digest": r["digest"], "n_hit": int(np.unpackbits(bits).sum()), "hits": bits.tobytes(), "items": sorted({x for m in r["items"] for x in m})})
            kind = pa.schema([_ARROW.field(c) for c in ("digest", "n_hit", "hits", "items")])
            yield pa.RecordBatch.from_pylist(out, kind)

    return found.mapInArrow(run, "digest string, n_hit long, hits binary, items array<string>")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
