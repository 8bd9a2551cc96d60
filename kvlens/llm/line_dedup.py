"""Removal of passages that repeat anywhere, by content-defined chunks of lines.

A line ends at a newline or after a sentence (so that a passage written as one
paragraph has lines too).  A line of more than ``LONG`` words also ends after words
chosen by their own bytes, one in ``DIVISOR`` or so, wherever they stand, so that text without
sentence ends is cut alike in all its copies.

1. A line is a boundary by its own hash: always with ``STEP`` words or more, else with a
   chance of its words / ``STEP``; where none comes for the words of a chunk, each further run of as many
   words has one too, counted from the last.  Boundaries are of two families, by another
   bit of the hash.  A chunk goes from a boundary to the next of its family, both included, over at least
   two lines and two thirds of ``min_words``; its key is a rolling hash of its lines' hashes.  Nothing but
   the lines of a chunk decides where it ends, so copies shifted by anything have the same.
   A line that has ``min_words`` alone is a chunk too.
2. Chunks that occur more than once, in the same text or another, point to their earlier places: the
   first (smallest document id, then place) in each of ``SHARES`` shares of the documents.
3. Neighbouring chunks that point into the same place of the same document are one
   run.  Only runs that no other run of the document covers go on, so a copy of a long document is one row.
4. The earlier place's bytes are brought to each run, with ``AROUND`` words before and
   after; the run's lines are compared with them byte by byte, and as long as lines
   are equal the run grows over its ends.
5. Runs of ``min_words`` words or more are removed with the white space after each line;
   the first occurrence stays, since no run points at a later one.

Three boundaries of which each two span a chunk's words always hold a chunk, as two of them are of one family: so
does any whole passage of three lines of eight words or more, by the defaults.  What is not removed: a passage's first and last line
where its surroundings are part of that line; half of the passages of two such lines; passages whose
chunks stand before it, in all shares, in texts without the rest.

Defined cases: a null text stays null, an empty text stays empty; rows that share an id are one document to the
search (its own lines are no copies of each other); a row without an id is left as
it is; a text all of which is copied becomes empty; an empty table gives no rows.  Other
columns pass through under any name, but for one named like the two counts, which the
count replaces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlens.session import materialise

from . import textcodes

LONG, DIVISOR, STEP = 16, 8, 6
SHARES = 4  # of the documents; a chunk points to its first place in each
AROUND = 64  # words brought from before and after an earlier place
HOT = 1024  # keys of 1/HOT of all chunks, so at most HOT of them, are joined without a shuffle
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Lines:
    """Lines of a batch of texts: ``cut`` their first bytes (one more at the end),
    ``stop`` the end of each without white space, ``words``, and ``first`` each text's
    first line (one more at the end)."""

    def __init__(self, texts: pa.Array):
        data, offs = textcodes.buffers(texts)
        begins, ends, first = textcodes.word_spans(data, offs)
        n = len(begins)
        opens = np.zeros(n, bool)
        if n:
            opens[1:] = _STOP[data[ends[:-1] - 1]]
            after = np.searchsorted(begins, np.flatnonzero(data == 10))
            opens[after[after < n]] = True
            opens[first[:-1][first[:-1] < first[1:]]] = True
        at = np.flatnonzero(opens)
        size = np.diff(np.append(at, n))
        w = np.flatnonzero(np.repeat(size > LONG, size))
        if len(w):
            b, e = begins[w], ends[w]
            looks = [data[b], data[(b + e) // 2], data[e - 1], np.minimum(e - b, 255)]
            code = sum(v.astype(np.uint64) << np.uint64(8 * i) for i, v in enumerate(looks))
            last = w[textcodes.mix(code) % np.uint64(DIVISOR) == 0]
            opens[last[last < n - 1] + 1] = True
            at = np.flatnonzero(opens)
        self.data, self.offs = data, offs
        self.first = np.searchsorted(at, first)
        self.begin, self.words = begins[at], np.diff(np.append(at, n))
        self.stop = ends[np.append(at, n)[1:] - 1] if n else np.empty(0, np.int64)

    def hashes(self) -> np.ndarray:
        return textcodes.word_hashes(self.data, self.begin, self.stop)

    def line(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.stop[i]].tobytes()


def boundaries(lines: Lines, h: np.ndarray, span: int) -> np.ndarray:
    """The lines that are boundaries, by their hashes ``h``."""
    first = lines.first[:-1][lines.first[:-1] < lines.first[1:]]
    chosen = textcodes.mix(h) % np.uint64(STEP) < lines.words.astype(np.uint64)
    origin = chosen.copy()
    origin[first] = True
    before = np.cumsum(lines.words) - lines.words
    since = (before - before[np.maximum.accumulate(np.where(origin, np.arange(len(h)), 0))]) // span
    chosen[1:] |= since[1:] > since[:-1]
    return np.flatnonzero(chosen)


def chunks(lines: Lines, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first line and number of lines of every chunk."""
    h = lines.hashes()
    if not len(h):
        return (np.empty(0, np.int64),) * 3
    span = max(2 * min_words // 3, 1)
    till = np.cumsum(lines.words)
    starts, family = boundaries(lines, h, span), (textcodes.mix(h) >> np.uint64(32)) & np.uint64(1)
    at, last = [], []
    for f in range(2):
        own = starts[family[starts] == f]
        least = np.maximum(np.searchsorted(till, till[own] - lines.words[own] + span), own + 1)
        end = np.append(own, len(h))[np.searchsorted(own, least)]
        inside = end < lines.first[np.searchsorted(lines.first, own, "right")]  # in the same text
        at.append(own[inside])
        last.append(end[inside])
    alone = np.flatnonzero(lines.words >= min_words)
    at, last = np.concatenate([*at, alone]), np.concatenate([*last, alone])
    return textcodes.rolling(h, at, last + 1).view(np.int64), at, last - at + 1


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield from textcodes.slices(b, column)


def _key_rows(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "text"):
            lines = Lines(b.column("text"))
            key, at, size = chunks(lines, min_words)
            text = np.searchsorted(lines.first, at, "right") - 1
            order = np.argsort(at, kind="stable")
            key, at, size, text = key[order], at[order], size[order], text[order]
            doc = b.column("doc").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(key), doc, pa.array(at - lines.first[text], pa.int32()), pa.array(size, pa.int32())], names=["key", "doc", "line", "n"])

    return rows


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asked part of a text: its lines, and those around it."""
    for b in _parts(batches, "text"):
        b = b.filter(pc.is_valid(b.column("asked")))
        lines, out = Lines(b.column("text")), []
        before = np.append(0, np.cumsum(lines.words))
        for i, (doc, asked) in enumerate(zip(b.column("doc").to_pylist(), b.column("asked").to_pylist())):
            base, n = int(lines.first[i]), int(lines.first[i + 1] - lines.first[i])
            for a in asked:
                here, there = before[base + a["from"]] - AROUND, before[base + a["till"]] + AROUND
                low = max(0, int(np.searchsorted(before, here)) - base)
                high = min(n, int(np.searchsorted(before, there, "right")) - 1 - base)
                out.append((doc, a["from"], a["till"], low, [lines.line(base + k) for k in range(low, high)]))
        if out:
            cols = [*zip(*out)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field("doc").type), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.list_(pa.binary()))],
                names=["src", "from", "till", "low", "lines"],
            )


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc, src, from, n, at``: runs of ``n`` lines, at each of ``at``, whose chunks occur before, at ``from`` of ``src``."""
    kind = docs.schema["doc"].dataType.simpleString()
    rows = materialise(docs.mapInArrow(_key_rows(min_words), f"key long, doc {kind}, line int, n int"), "chunks")
    share = F.pmod(F.xxhash64("doc"), F.lit(SHARES))
    places = [F.min(F.when(share == i, F.struct("doc", "line"))).alias(f"p{i}") for i in range(SHARES)]
    known = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *places).where("m > 1")
    known = materialise(known.select("key", "m", F.array_compact(F.array(*[f"p{i}" for i in range(SHARES)])).alias("places")), "places")
    hot = F.col("m") * HOT >= F.lit(rows.count())
    few = F.broadcast(known.where(hot).select("key", "places"))  # at most HOT rows
    found = rows.join(few, "key").unionByName(rows.join(F.broadcast(known.where(hot).select("key")), "key", "left_anti").join(known.where(~hot).select("key", "places"), "key"))
    earlier = F.filter("places", lambda p: (p["doc"] < F.col("doc")) | ((p["doc"] == F.col("doc")) & (p["line"] < F.col("line"))))
    found = found.select("doc", "line", "n", F.explode(earlier).alias("p")).select("doc", "line", "n", F.col("p.doc").alias("src"), F.col("p.line").alias("from"))
    found = found.withColumn("shift", F.col("from") - F.col("line")).repartition("doc")  # all windows below are of one text
    # Chunks of one document that point alike and touch or overlap are one run.
    w = Window.partitionBy("doc", "src", "shift").orderBy("line", "n")
    till = F.max(F.col("line") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", (till.isNull() | (F.col("line") > till)).cast("int"))
    found = found.withColumn("run", F.sum("new").over(w))
    runs = found.groupBy("doc", "src", "shift", "run").agg(F.min("line").alias("line"), F.max(F.col("line") + F.col("n")).alias("till"))
    # A run inside another of its document adds nothing.
    w = Window.partitionBy("doc").orderBy("line", F.desc("till"), "src", "shift").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("covered", F.max("till").over(w)).where(F.col("covered").isNull() | (F.col("till") > F.col("covered")))
    runs = runs.select("doc", "line", (F.col("till") - F.col("line")).cast("long").alias("n"), "src", (F.col("line") + F.col("shift")).cast("long").alias("from"))
    # A text that repeats the same lines points at one place many times, and gets its excerpt once.
    return runs.groupBy("doc", "src", "from", "n").agg(F.collect_list("line").alias("at"))  # of one text


def copied_lines(lines: Lines, i: int, runs: list[dict], min_words: int) -> np.ndarray:
    """Which lines of text ``i`` are copies, by comparing bytes with the excerpts."""
    base, n = int(lines.first[i]), int(lines.first[i + 1] - lines.first[i])
    gone = np.zeros(n, bool)
    words = lines.words[base : base + n]
    for line, run in ((line, run) for run in runs for line in run["at"]):
        there, shift = run["lines"], run["from"] - line
        same = lambda k: 0 <= k < n and 0 <= k + shift - run["low"] < len(there) and lines.line(base + k) == there[k + shift - run["low"]]  # noqa: B023, E731
        k, end = line, min(line + run["n"], n)
        while k < end:
            if not same(k):
                k += 1
                continue
            a = z = k
            while same(a - 1):
                a -= 1
            while same(z + 1):
                z += 1
            if words[a : z + 1].sum() >= min_words:
                gone[a : z + 1] = True
            k = z + 1
    return gone


def remove_repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 25, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``df`` with the copies cut out of ``text``, and two counts of its lines."""
    docs = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    runs = materialise(repeated_runs(docs, min_words), "runs")
    kind = docs.schema["doc"].dataType.simpleString()
    asked = runs.select("src", "from", (F.col("from") + F.col("n")).alias("till")).distinct()
    asked = asked.groupBy("src").agg(F.collect_list(F.struct("from", "till")).alias("asked"))  # parts of one text
    # The table's other columns travel as one, so their names meet none of ours.
    others = [c for c in df.columns if c not in (doc_id, text)]
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"), (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("rest"))
    # Both joins deal the same columns of all rows by id, so that Spark shuffles the texts once.
    parts = rows.join(asked, rows["id"] == asked["src"], "left")
    parts = parts.select(F.col("id").alias("doc"), F.when(F.col("asked").isNotNull(), F.col("body")).alias("text"), "asked", "rest")
    parts = parts.mapInArrow(_excerpts, f"src {kind}, from long, till long, low long, lines array<binary>").dropDuplicates(["src", "from", "till"])
    runs = runs.withColumn("till", F.col("from") + F.col("n")).join(parts, ["src", "from", "till"])
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "from", "low", "lines")).alias("runs"))  # of one text

    joined = rows.join(runs, rows["id"] == runs["doc"], "left").select("id", "body", "rest", "runs")
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("lines", T.LongType()), T.StructField("removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "body"):
            column = b.column("body")
            lines, out, removed = Lines(column), [], []
            for i, found in enumerate(b.column("runs").to_pylist()):
                gone = copied_lines(lines, i, found, min_words) if found else None
                if gone is None or not gone.any():
                    out.append(column[i].as_py())
                    removed.append(0)
                    continue
                base, edge = int(lines.first[i]), int(lines.offs[i + 1])
                starts = np.append(lines.begin[base : base + len(gone)], edge)
                keep = [lines.data[starts[k] : starts[k + 1]].tobytes() for k in np.flatnonzero(~gone)]
                out.append(b"".join(keep).decode().rstrip(" \t\n\r\v\f") if gone[-1] else b"".join(keep).decode())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, column.type), b.column("rest"), pa.array(np.diff(lines.first), pa.int64()), pa.array(removed, pa.int64())], names=schema.fieldNames())

    made = joined.mapInArrow(cut, schema)
    own = {doc_id: F.col("id"), text: F.col("body")}
    kept = [own.get(c, F.col("rest").getField(c)).alias(c) for c in df.columns if c not in (n_lines, n_removed)]
    return made.select(*kept, F.col("lines").alias(n_lines), F.col("removed").alias(n_removed))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
