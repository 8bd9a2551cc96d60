"""Hierarchical Pitman-Yor language model, and the log-probability of texts.

Tokens are the words of a text (``textcodes``) and an end token.  Restaurants:

* one for every *context*, the token before (the end token stands before the first
  one).  Its dishes are the tokens that follow it, whatever their counts;
* a root, the parent of all of them: the tables of the context restaurants are its
  customers, all types its dishes; its base is uniform over them and one unknown type.

Seating is sampled by Gibbs sweeps: a sweep unseats the customers of every dish and
seats them again by the Chinese-restaurant rule, given the tables of the other
dishes and the parent's present predictive probabilities; all dishes and
restaurants of a sweep are sampled at once (the usual parallel Gibbs
approximation).  Customers of a large dish are seated in groups of a sixteenth of those
present.  The discount of each level comes from its counts of ones and twos.
``SAMPLES`` chains run side by side, ``BURN_IN`` sweeps and one each, and a token's
predictive probability is the mean over their last seatings.

Scale: one exchange deals all tokens by their context, packed: for a run of texts and a part
the contexts, the tokens of each, and how often training has each pair; the
65,535 most frequent types as two bytes.  Every later pass reads these files where
they are.  Which documents hold a pair goes to the run's *home*, one part for each run.  A part
counts and seats its own restaurants; only tables per type go to the root's
parts and back.  The home gets each distinct pair's probability and each context's customers once for
its run, however many parts there are, and adds up its documents.  A pair of one customer has one table, so only
pairs of more are seated anew.  A context of 1/``HEAVY`` of the tokens (at most ``HEAVY`` of
them) lies in all parts, by its tokens, and is added up over them; else no part could
take a share.  A text's contexts are its tokens in another order, so
the customers of contexts are the counts of types too.

Defined cases: a null text is empty and scores its end token; repeated
rows are scored each; a null id is held out of training; without training
rows every token has probability 1/(V+1) = 1; a context that training lacks has no
customers and asks the root.

``Classes``, ``_context_model`` and ``_other_model`` are a coarser model, of frequent
tokens and the rest as one; no query scores with it.
"""

from __future__ import annotations

import pickle
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from kvlens.session import materialise

from . import textcodes

HEAD = 1024
CODES, FREQUENT = 65_535, 16_384  # types with codes of two bytes; types that a task names for these
HEAVY = 2048  # pairs of a context of 1/HEAVY of the tokens are dealt by their tokens
BURN_IN, SAMPLES, CONCENTRATION = 2, 4, 1.0
MERGE = 1_000_000  # counts that a task holds before it combines them
SLICE, ROWS = 1 << 20, 50_000  # bytes of text that a task reads at a time; rows that it gives at a time
RUN = 4 << 20  # bytes of text whose pairs are packed together
FRACTION = 34  # bits behind the point of a probability's logarithm that a part sends (within 3e-11)


def held_out(doc_id: Column, modulus: int = 10, remainder: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and each text's first token."""
    words, first = textcodes.hashed_words(texts)
    n = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begin[-1], np.int64)
    end = np.zeros(begin[-1], bool)
    end[begin[1:] - 1] = True
    out[end] = textcodes.END
    out[~end] = words.view(np.int64)
    return out, begin


class Counter:
    """Counts of long keys, combined whenever many have come."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > MERGE:
            keys, counts = self.all()
            self.keys, self.counts, self.waiting = [keys], [counts], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(counts[order], at)


def runs(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield from textcodes.slices(b, column, limit)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = Counter()
    for b in runs(batches, "text"):
        w, _ = tokens(b.column("text"))
        c.add(*np.unique(w, return_counts=True))
    keys, n = c.all()
    for i in range(0, len(keys), 1_000_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 1_000_000]), pa.array(n[i : i + 1_000_000])], names=["w", "c"])


def noise(keys: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key, sweep and step alone, so that a
    retried task draws the same."""
    salt = np.uint64(((sweep * 1_000_003 + step) * 0x9E3779B97F4A7C15) % 2**64)
    return (textcodes.mix(keys.view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) / 2**53


def seat(keys: np.ndarray, customers: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers were seated anew.  ``others``:
    tables of the other dishes in its restaurant; ``parent``: its probability there."""
    tables, seated, step = np.ones(len(keys)), np.ones(len(keys)), 0
    left = np.flatnonzero(customers > 1)
    while len(left):
        n, t = seated[left], tables[left]
        group = np.minimum(np.maximum(np.floor(n / 16), 1), customers[left] - n)
        new = (CONCENTRATION + d * (others[left] + t)) * parent[left]
        p = new / (new + n - d * t)
        tables[left] += np.floor(group * p + noise(keys[left], sweep, step))
        seated[left] += group
        left = left[seated[left] < customers[left]]
        step += 1
    return tables


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


class Classes:
    """Frequent tokens by number; every other token is ``n``, the begin of a text ``n + 1``."""

    def __init__(self, head: np.ndarray):
        self.head, self.n = np.sort(head), len(head)

    def of(self, w: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(self.head, w), self.n - 1)
        return np.where(self.head[at] == w, at, self.n)

    def pairs(self, w: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """context * (n + 2) + token, for each token."""
        c = self.of(w)
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[begin[:-1]] = self.n + 1
        return before * (self.n + 2) + c


def _context_model(train: DataFrame, classes: Classes, name: str) -> np.ndarray:
    """log10 P_u(w) for each context (rows) and dish (columns)."""
    size, n = classes.n + 2, classes.n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(size * size, np.int64)
        for b in runs(batches, "text"):
            c += np.bincount(classes.pairs(*tokens(b.column("text"))), minlength=size * size)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(c[at])], names=["u", "w", "c"])

    counts = train.select("text").mapInArrow(count, "u long, w long, c long").groupBy("u", "w").agg(F.sum("c").alias("c"))
    state = materialise(counts.withColumn("t", F.lit(1.0)).withColumn("p", F.lit(0.0)).withColumn("back", F.array().cast("array<double>")), name)
    few = state.agg(F.sum((F.col("c") == 1).cast("int")).alias("ones"), F.sum((F.col("c") == 2).cast("int")).alias("twos")).first()
    d, root, kept = discount(few["ones"] or 0, few["twos"] or 0), np.full(n + 1, 1 / (n + 1)), []
    for sweep in range(BURN_IN + SAMPLES):
        parent, sample = root, sweep >= BURN_IN

        def restaurant(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("w", ignore_index=True)
            c, w, t = g["c"].to_numpy(float), g["w"].to_numpy(), g["t"].to_numpy()
            keys = (g["u"].to_numpy() * size + w).astype(np.int64)
            t = seat(keys, c, parent[w], t.sum() - t, d, sweep)
            if sample:
                total = CONCENTRATION + c.sum()
                back = (CONCENTRATION + d * t.sum()) / total
                g["p"] += ((c - d * t) / total + back * parent[w]) / SAMPLES
                g["back"] = [[*x, back] for x in g["back"]]
            return g.assign(t=t)

        if sample:
            kept.append(parent)
        state = materialise(state.groupBy("u").applyInPandas(restaurant, state.schema), name)
        tables = np.zeros(n + 1)
        for r in state.groupBy("w").agg(F.sum("t").alias("t")).collect():  # at most n + 1 rows
            tables[r["w"]] = r["t"]
        # The root: its customers are the tables below, its base is uniform.
        dishes = np.flatnonzero(tables)
        at, base = np.ones(len(dishes)), np.full(len(dishes), 1 / (n + 1))
        for inner in range(3):
            at = seat(dishes.astype(np.int64) - 7, tables[dishes], base, at.sum() - at, d, 1000 + 3 * sweep + inner)
        own = np.zeros(n + 1)
        own[dishes] = at
        root = (np.maximum(tables - d * own, 0) + (CONCENTRATION + d * at.sum()) / (n + 1)) / (CONCENTRATION + tables.sum())
    out = np.empty((size, n + 1))
    out[:] = np.mean(kept, axis=0)  # a context never seen has no customers and asks the root
    for r in state.groupBy("u").agg(F.first("back").alias("back")).collect():  # at most n + 2 rows
        out[r["u"]] = np.mean([b * k for b, k in zip(r["back"], kept)], axis=0)
    for r in state.select("u", "w", "p").toLocalIterator():  # at most (n + 2) * (n + 1) rows, a row group at a time
        out[r["u"], r["w"]] = r["p"]
    return np.log10(out)


def _other_model(counts: DataFrame, classes: Classes, name: str) -> tuple[DataFrame, float]:
    """``w, c, lp``: log10 P_other of each infrequent token, and that of an unknown one."""
    other = counts.where(~F.col("head"))
    few = other.agg(F.count("w").alias("types"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("ones"), F.sum((F.col("c") == 2).cast("long")).alias("twos")).first()
    types, n, d = few["types"], few["n"] or 0, discount(few["ones"] or 0, few["twos"] or 0)
    base, total, samples = 1 / (types + 1), float(types), []

    def tables_of(w: np.ndarray, c: np.ndarray, total: float, sweep: int) -> np.ndarray:
        return seat(w, c.astype(float), np.full(len(w), base), np.full(len(w), total - 1), d, sweep)

    for sweep in range(BURN_IN + SAMPLES):
        now = total

        def sweep_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sum(float(tables_of(b.column(0).to_numpy(), b.column(1).to_numpy(), now, sweep).sum()) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([float(t)])], names=["t"])

        if types:
            total = other.select("w", "c").mapInArrow(sweep_tables, "t double").agg(F.sum("t")).first()[0]
        if sweep >= BURN_IN:
            samples.append((now, total, sweep))
    back = np.mean([(CONCENTRATION + d * t) / (CONCENTRATION + n) * base for _, t, _ in samples])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w, c = b.column(0).to_numpy(), b.column(1).to_numpy()
                t = np.mean([tables_of(w, c, before, sweep) for before, _, sweep in samples], axis=0)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.log10((c - d * t) / (CONCENTRATION + n) + back))], names=["w", "c", "lp"])

    return other.select("w", "c").mapInArrow(predict, "w long, c long, lp double"), float(np.log10(back))


def contexts(w: np.ndarray, begin: np.ndarray, end: int = textcodes.END) -> np.ndarray:
    """The token before each token; before a text's first one, the end token."""
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[begin[:-1]] = end
    return before


def count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent tokens; every token of 1/``FREQUENT`` of its texts is one of them."""
    for b in count_tokens(batches):
        c = b.column(1).to_numpy()
        yield b.take(pa.array(np.sort(np.argsort(-c, kind="stable")[:FREQUENT])))


CHAINS = range(SAMPLES)


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def _places(a: np.ndarray) -> np.ndarray:
    """The bytes of each place of whole numbers together, which packs them closer."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _numbers(places: np.ndarray) -> np.ndarray:
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, : len(places)] = places.T
    return out.view(np.int64)[:, 0]


def _release() -> None:
    """A worker lives on between tasks: what Arrow holds for later goes back."""
    pa.default_memory_pool().release_unused()


def _dump(*parts) -> bytes:
    raw = pickle.dumps(parts, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _load(blob: bytes) -> tuple:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


class Routes:
    """Where pairs and types go, and two-byte codes of frequent types, by their frequency."""

    def __init__(self, frequent: np.ndarray, heavy: np.ndarray, parts: int):
        self.frequent, self.heavy, self.parts = frequent, np.sort(heavy), parts
        self.order = np.argsort(frequent)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), CODES, np.uint16)
        at, hit = _find(self.frequent[self.order], x)
        out[hit] = self.order[at[hit]]
        return out

    def unpack(self, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int64)
        rare = codes == CODES
        out[rare] = _numbers(rest)
        out[~rare] = self.frequent[codes[~rare]]
        return out

    def of(self, x: np.ndarray) -> np.ndarray:
        """The part of each type."""
        return (textcodes.mix(x.view(np.uint64) ^ np.uint64(0x5EA7)) % np.uint64(self.parts)).astype(np.int64)

    def pairs(self, types: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The part of each pair: that of its context; pairs of a heavy context lie at their tokens."""
        part, heavy = self.of(types), _find(self.heavy, types)[1]
        return np.where(heavy[u], part[w], part[u])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each x among them; in place where it can, for a task has little memory."""
    order = np.argsort(x)
    x = x[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    x = x[new]
    at = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    at[order] = np.cumsum(new, dtype=at.dtype) - at.dtype.type(1)
    return x, at


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _fixed(lp: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities as whole numbers, the bytes of each place together."""
    return _places(np.rint(np.maximum(-lp, 0) * 2.0**FRACTION).astype(np.int64))


def _unfixed(places: np.ndarray) -> np.ndarray:
    return _numbers(places) * -(2.0**-FRACTION)


def _packed(row: int, home: int, ids: pa.Array, size: np.ndarray, held: np.ndarray, types: np.ndarray, u: np.ndarray, w: np.ndarray, routes: Routes) -> Iterator[tuple[int, bytes]]:
    """Of a run of texts, for each part its pairs: contexts, tokens of each and how often training has the pair here;
    and for the run's home the documents of each pair, in the order of the parts, and how often it stands there."""
    doc = np.repeat(np.arange(len(size)), size)
    if len(types) < 1 << 24:
        key, n = np.unique(u.astype(np.uint64) << np.uint64(40) | w.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64), return_counts=True)
        u, w, doc = (key >> np.uint64(40)).astype(np.int64), (key >> np.uint64(16)).astype(np.int64) & 0xFFFFFF, key.astype(np.int64) & 0xFFFF
    else:
        u, w, doc, n = _combined(u, w, doc)
    codes = routes.codes(types)
    packed = lambda of: (codes[of], _places(types[of[codes[of] == CODES]]))
    part = routes.pairs(types, u, w)
    order = np.argsort(part, kind="stable")
    part, u, w, doc, n = part[order], u[order], w[order], doc[order], n[order]
    new_u = (np.diff(part, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0)
    pair = np.flatnonzero(new_u | (np.diff(w, prepend=-1) != 0))
    first = np.flatnonzero(new_u[pair])
    un, wn = np.diff(first, append=len(pair)), np.diff(pair, append=len(u))
    learnt = np.add.reduceat(np.where(held[doc], 0, n), pair)
    part, u, w = part[pair], u[pair[first]], w[pair]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    of = part[cuts[:-1]]
    cuts_u = np.searchsorted(first, cuts)
    for p, a, z, ua, uz in zip(of, cuts[:-1], cuts[1:], cuts_u[:-1], cuts_u[1:]):
        yield int(p), _dump(row, home, *packed(u[ua:uz]), _narrow(un[ua:uz]), *packed(w[a:z]), _narrow(learnt[a:z]))
    yield routes.parts + home, _dump(row, ids, _narrow(size), _narrow(of), _narrow(un), _narrow(wn), _places(_narrow(doc)), _narrow(n))


class Part:
    """The pairs of one part, from its packed tokens."""

    def __init__(self, packed: list[tuple], routes: Routes):
        size = sum(len(x[5]) for x in packed)
        self.runs, u, c = [], [np.empty(0, np.int64)], np.empty(size, np.int64)
        begin, w = 0, np.empty(size, np.int64)
        for row, home, uc, ur, un, wc, wr, n in packed:
            u.append(routes.unpack(uc, ur))
            end = begin + len(wc)
            w[begin:end] = routes.unpack(wc, wr)
            c[begin:end] = n
            self.runs.append((row, home, begin, end, un))
            begin = end
        self.us, ui = _distinct(np.concatenate(u))
        times = np.concatenate([np.empty(0, np.uint8), *[x[4] for x in packed]])
        self.ws, wi = _distinct(w)
        del w
        key = np.repeat(ui, times).astype(np.int64)
        key <<= 32
        key |= wi
        del ui, wi
        key, self.at = _distinct(key)
        self.c = np.bincount(self.at, c, len(key))
        self.u, self.w = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        self.many, self.alone = self.c > 1, self.c == 1

    def sums(self, by: np.ndarray, size: int, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(by[of], values[of], size)


def _total(x, y):
    return [a + b for a, b in zip(x, y)]


class PairModel:
    """The restaurants of all contexts.  ``docs``: ``text``, and if there are such, ``doc_id`` and ``held``
    (not learnt from); ``counts``: ``w, c`` of frequent types at least."""

    def __init__(self, docs: DataFrame, counts: DataFrame):
        self.spark = spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        top = counts.orderBy(F.desc("c"), "w").limit(CODES).toPandas()  # at most CODES rows
        w, c = top["w"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
        self.routes = routes = Routes(w, w[c * HEAVY >= c.sum()], parts)
        self.kind = docs.schema["doc_id"].dataType.simpleString() if "doc_id" in docs.columns else "long"
        doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")
        held = F.col("held") if "held" in docs.columns else F.lit(False)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = TaskContext.get().partitionId()
            row, home = p << 33, p % parts
            for b in runs(batches, "text", RUN):
                for b in (b.slice(i, 1 << 16) for i in range(0, b.num_rows, 1 << 16)):
                    w, begin = tokens(b.column("text"))
                    ids = b.column("doc_id").take(pa.array(np.arange(b.num_rows)))  # a copy: a slice would be sent with all its batch
                    types, w = np.unique(w, return_inverse=True)
                    u = contexts(w, begin, int(np.searchsorted(types, textcodes.END)))
                    out = [*_packed(row, home, ids, np.diff(begin), b.column("held").to_numpy(zero_copy_only=False), types, u, w, routes)]
                    row, home = row + b.num_rows, (home + parts * 5 // 8 + 1) % parts  # a task's later runs have other homes than its neighbours'
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["p", "b"])

        rows = docs.select(doc_id.alias("doc_id"), held.alias("held"), "text").mapInArrow(read, "p int, b binary")
        #: All tokens by part, and by part + ``parts`` (the same partition) the documents at home there; the model's passes read them where this exchange left them.
        self.tokens = rows.rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(parts)
        self.kept = []
        first = self._keep(self.tokens.mapPartitions(self._first, True))
        (ones,), (twos,), (n,), alone, many, self.customers = self._sum(first)
        self.d, self.n = discount(ones, twos), int(n)
        self.heavy = [alone + many] * SAMPLES  # tables in the restaurants of heavy contexts, by chain
        self.asked = self._sent(first)  # the types that each part asks for
        few = self.asked.mapPartitions(self._few).treeReduce(_total)
        self.v, self.base, self.d_root = int(few[0]), 1 / (few[0] + 1), discount(few[1], few[2])
        fixed, seated, root = first.filter(lambda r: r[1][0] == "pairs"), None, [float(few[0])] * SAMPLES
        for sweep in range(BURN_IN + 2):
            last = sweep == BURN_IN + 1
            types = self._keep((self.asked if seated is None else self._sent(seated).union(self.asked)).mapPartitions(self._types(root, sweep, last), True))
            sums = self._sum(types)
            root = self.root_tables = [float(x) for x in sums[0]]
            self.root_customers = [float(x) for x in sums[1]]
            if last:
                break
            state = fixed if seated is None else seated.filter(lambda r: r[1][0] == "tables").union(fixed)
            now = self._keep(self._sent(types, "root").union(state).mapPartitions(self._sweep(self._roots(), self.heavy, sweep), True))
            self.heavy = [alone + t for t in self._sum(now)]
            self._drop(types, *([seated] if seated else []))
            seated = now
        self._drop(first)
        self.seated, self.last = seated, types
        tables = types.filter(lambda r: r[1][0] == "types").map(lambda r: r[1][2])
        self.types = materialise(self._frame(tables, "x long", *[f"{k}{j} double" for k in ("at", "r") for j in CHAINS]), "lm-types")

    def _keep(self, rdd):
        self.kept.append(rdd.persist(StorageLevel.DISK_ONLY))
        return rdd

    def _drop(self, *rdds) -> None:
        for rdd in rdds:
            rdd.unpersist()
            self.kept.remove(rdd)

    def close(self) -> None:
        self._drop(*self.kept)

    def _sum(self, rdd):
        return rdd.filter(lambda r: r[1][0] == "sum").map(lambda r: r[1][2]).treeReduce(_total)

    def _sent(self, rdd, kind: str = "asks"):
        """Records of a kind at the part that they are for."""
        return rdd.filter(lambda r: r[1][0] == kind).map(lambda r: (r[1][1], (kind, r[0], r[1][2]))).partitionBy(self.routes.parts)

    def _frame(self, blobs, *columns: str) -> DataFrame:
        kinds = StructType.fromDDL(", ".join(columns))
        return self.spark.createDataFrame(blobs.map(lambda b: (bytearray(b),)), "b binary").mapInArrow(_rows(kinds.names, [to_arrow_type(f.dataType) for f in kinds]), kinds)

    @property
    def _first(self):
        """Counts the pairs; what later passes need of those with more customers; asks for all types."""
        routes = self.routes

        def run(records):
            p, packed = TaskContext.get().partitionId(), []
            for k, b in records:
                if k < routes.parts:
                    packed.append(_load(b))
            x = Part(packed, routes)
            del packed
            at, heavy = _find(routes.heavy, x.us)
            size = len(routes.heavy)
            inside = x.sums(x.u, len(x.us), np.ones(len(x.u)), x.alone)
            many = x.sums(x.u, len(x.us), np.ones(len(x.u)), x.many)
            customers = np.bincount(x.u, x.c, len(x.us))
            per = lambda v: np.bincount(at[heavy], v[heavy], size)
            yield p, ("sum", None, [np.array([x.alone.sum()], float), np.array([(x.c == 2).sum()], float), np.array([x.c.sum()]), per(inside), per(many), per(customers)])
            us, ui = np.unique(x.u[x.many], return_inverse=True)
            ws, wi = np.unique(x.w[x.many], return_inverse=True)
            yield p, ("pairs", None, _dump(x.us[us], _narrow(ui), _narrow(inside[us].astype(np.int64)), x.ws[ws], _narrow(wi), _narrow(x.c[x.many].astype(np.int64))))
            part = routes.of(x.ws)
            counts = [x.sums(x.w, len(x.ws), np.ones(len(x.w)), of).astype(np.int64) for of in (x.alone, x.many)]
            for q in np.unique(part):
                yield p, ("asks", int(q), _dump(x.ws[part == q], *[_narrow(c[part == q]) for c in counts]))
            del x
            _release()

        return run

    @property
    def _few(self):
        def run(records):
            _, _, at = _asked(list(records))
            yield [float((at[0] > 0).sum()), float((at[0] == 1).sum()), float((at[0] == 2).sum())]

        return run

    def _types(self, root: list[float], sweep: int, last: bool):
        """Seats the root; each part gets the tables of the types that it asked for."""
        base, d = self.base, self.d_root

        def run(records):
            q = TaskContext.get().partitionId()
            w, asked, at = _asked(list(records))
            here = at[0] > 0
            r = np.zeros((SAMPLES, len(w)))
            for j in CHAINS:
                m = int(here.sum())
                r[j, here] = seat(w[here], at[j][here], np.full(m, base), np.full(m, root[j] - 1), d, 1000 + sweep * SAMPLES + j)
            yield q, ("sum", None, [r.sum(1), at.sum(1)])
            both = np.concatenate([at, r]).astype(np.int64)
            for p, (rows, many) in asked.items():
                of = rows if last else rows[many]
                yield q, ("root", p, _dump(*[_narrow(x[of]) for x in both]))
            if last:
                yield q, ("types", None, _dump(w[here], *[_narrow(x[here]) for x in both]))

        return run

    def _roots(self):
        """What turns the root's tables into its probabilities."""
        return self.d_root, list(self.root_customers), [self.unknown(j) for j in CHAINS]

    def _sweep(self, roots: tuple, heavy: list[np.ndarray], sweep: int):
        routes, d = self.routes, self.d

        def run(records):
            p, got = TaskContext.get().partitionId(), defaultdict(list)
            for _, r in records:
                got[r[0]].append(r)
            us, ui, inside, ws, wi, c = _load(got["pairs"][0][2])
            c = c.astype(float)
            t = np.array(_load(got["tables"][0][2]), float) if got["tables"] else np.ones((SAMPLES, len(c)))
            part = routes.of(ws)
            prob = _probabilities(part, got["root"], *roots)
            at, is_heavy = _find(routes.heavy, us)
            keys = _pair_hash(us[ui], ws[wi]).view(np.int64)
            for j in CHAINS:
                total = inside + np.bincount(ui, t[j], len(us))
                total[is_heavy] = heavy[j][at[is_heavy]]
                t[j] = seat(keys, c, prob[j][wi], total[ui] - t[j], d, sweep * SAMPLES + j)
            yield p, ("tables", None, _dump(*[_narrow(x.astype(np.int64)) for x in t]))
            inside = [np.bincount(ui, x, len(us)) for x in t]
            yield p, ("sum", None, [np.bincount(at[is_heavy], x[is_heavy], len(routes.heavy)) for x in inside])
            at_dish = [np.bincount(wi, x, len(ws)).astype(np.int64) for x in t]
            for q in np.unique(part):
                yield p, ("asks", int(q), _dump("tables", *[_narrow(x[part == q]) for x in at_dish]))

        return run

    def unknown(self, j: int) -> float:
        """The root's probability of a type that training lacks."""
        return (CONCENTRATION + self.d_root * self.root_tables[j]) / (CONCENTRATION + self.root_customers[j]) * self.base

    def dishes(self, types: DataFrame) -> DataFrame:
        """``w, p..``: the root's probability of each type."""
        p = lambda j: (F.col(f"at{j}") - self.d_root * F.col(f"r{j}")) / (CONCENTRATION + self.root_customers[j]) + self.unknown(j)
        return types.select(F.col("x").alias("w"), *[p(j).alias(f"p{j}") for j in CHAINS])

    def _scored(self, out):
        """What ``out`` makes of each part with its pairs' probabilities."""
        routes, d, roots, heavy, customers = self.routes, self.d, self._roots(), self.heavy, self.customers

        def run(records):
            packed, got = [], defaultdict(list)
            for k, r in records:
                if isinstance(r, tuple):
                    got[r[0]].append(r)
                elif k < routes.parts:
                    packed.append(_load(r))
            x = Part(packed, routes)
            del packed
            prob = _probabilities(routes.of(x.ws), got["root"], *roots)
            at = _find(routes.heavy, x.us)
            tables, t = _load(got["tables"][0][2]), x.alone.astype(float)
            got.clear()
            x.uc = np.bincount(x.u, x.c, len(x.us))
            x.uc[at[1]] = customers[at[0][at[1]]]
            x.back, seated, mean = np.empty((SAMPLES, len(x.us))), np.zeros(len(x.c)), np.zeros(len(x.c))
            for j in CHAINS:
                t[x.many] = tables[j]
                seated += t
                total = np.bincount(x.u, t, len(x.us))
                total[at[1]] = heavy[j][at[0][at[1]]]
                x.back[j] = (CONCENTRATION + d * total) / (CONCENTRATION + x.uc)
                mean += x.back[j][x.u] * prob[j][x.w]
            del t, prob
            x.lp = np.log10((x.c - d * (seated / SAMPLES)) / (CONCENTRATION + x.uc[x.u]) + mean / SAMPLES)
            del mean, seated
            yield from out(x)
            del x
            _release()

        tables = self.seated.filter(lambda r: r[1][0] == "tables")
        return self._sent(self.last, "root").union(tables).union(self.tokens).mapPartitions(run)

    def restaurants(self) -> DataFrame:
        """``u, uc, back..``: customers of each context, and the part of its probability that goes to the root."""

        def out(x: Part):
            of = x.uc > 0
            yield _dump(x.us[of], x.uc[of], *[b[of] for b in x.back])

        return self._frame(self._scored(out), "u long", "uc double", *[f"back{j} double" for j in CHAINS]).dropDuplicates(["u"])  # a heavy context is in many parts

    def log10_pairs(self) -> DataFrame:
        """``u, w, c, lp``: log10 P_u(w) of every pair of training."""

        def out(x: Part):
            of = x.c > 0
            yield _dump(x.us[x.u[of]], x.ws[x.w[of]], x.c[of], x.lp[of])

        return self._frame(self._scored(out), "u long", "w long", "c double", "lp double")

    def _answers(self):
        """To each home, of its runs' pairs in a part the customers of each context and log10 of each pair's probability."""

        def out(x: Part):
            p, found = TaskContext.get().partitionId(), defaultdict(list)
            for row, home, begin, end, un in x.runs:
                pair = x.at[begin:end]
                first = np.cumsum(un, dtype=np.int64) - un
                found[home].append((row, _places(_narrow(x.uc[x.u[pair[first]]].astype(np.int64))), _fixed(x.lp[pair])))
            for home, answers in found.items():
                yield p, ("answers", home, _dump(*answers))

        return self._scored(out)

    def documents(self) -> DataFrame:
        """``doc_id, n_tokens, n_known, base, lp`` of each document, added up at its home."""
        floor = np.log10(self.n + 0.1 * (self.v + 1)) if self.n else 0.0
        learnt, parts = self.n > 0, self.routes.parts

        def run(records):
            texts, answers = [], defaultdict(dict)
            for k, r in records:
                if isinstance(r, tuple):
                    for row, uc, lp in _load(r[2]):
                        answers[row][r[1]] = uc, lp
                elif k >= parts:
                    texts.append(_load(r))
            for row, ids, size, of, un, wn, doc, n in texts:
                found = answers.pop(row)
                doc, uc = _numbers(doc), np.concatenate([_numbers(found[p][0]) for p in of])
                lp = np.concatenate([_unfixed(found[p][1]) for p in of])
                # A text's contexts are its tokens in another order (the end token stands before the first), so customers of contexts are counts of tokens.
                base = np.log10(uc + 0.1) - floor if learnt else np.zeros(len(uc))
                pair = np.repeat(np.arange(len(wn)), wn)
                u = np.repeat(np.arange(len(un)), un)[pair]
                known, base, lp = (np.bincount(doc, n * v, len(size)) for v in ((uc > 0)[u], base[u], lp[pair]))
                yield _dump(ids, size.astype(np.int64), known.astype(np.int64), base, lp)
            _release()

        sums = self._sent(self._answers(), "answers").union(self.tokens).mapPartitions(run)
        return self._frame(sums, f"doc_id {self.kind}", "n_tokens long", "n_known long", "base double", "lp double")


def _asked(records: list) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The types of a part in order, of each part that asks the places of its types and which of them have pairs
    of more than one customer, and the tables at each type's dish, by chain."""
    asks, tables = {}, {}
    for _, (_, p, blob) in records:
        x = _load(blob)
        (tables if isinstance(x[0], str) else asks)[p] = x
    if not asks:
        return np.empty(0, np.int64), {}, np.zeros((SAMPLES, 0))
    w, rows = np.unique(np.concatenate([a[0] for a in asks.values()]), return_inverse=True)
    at, asked, begin = np.zeros((SAMPLES, len(w))), {}, 0
    for p, (mine, alone, many) in asks.items():
        here = rows[begin : begin + len(mine)]
        begin += len(mine)
        asked[p] = here, many > 0
        for j in CHAINS:
            at[j][here] += alone  # a part asks once for a type
            if p in tables:
                at[j][here[many > 0]] += tables[p][1 + j]
            elif not tables:
                at[j][here] += many  # before the first sweep: one table each
    return w, asked, at


def _probabilities(part: np.ndarray, replies: list, d: float, customers: list[float], unknown: list[float]) -> np.ndarray:
    """The root's probability of each type, by chain, from the replies of the parts of the types."""
    p = np.empty((SAMPLES, len(part)))
    p[:] = np.array(unknown)[:, None]
    for _, q, blob in replies:
        x, of = _load(blob), part == q
        for j in CHAINS:
            if customers[j]:
                p[j][of] = (x[j] - d * x[SAMPLES + j]) / (CONCENTRATION + customers[j]) + unknown[j]
    return p


def _rows(names: list[str], kinds: list[pa.DataType]):
    """Rows of blobs that hold a column each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                columns = _load(blob.as_py())
                m = len(columns[0])
                for i in range(0, m, ROWS):
                    part = [pa.nulls(min(ROWS, m - i), t) if c is None else pa.array(c[i : i + ROWS]).cast(t) if isinstance(c, np.ndarray) else c[i : i + ROWS] for c, t in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays(part, names=names)

    return run


def score_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 10, remainder: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    held = held_out(F.col(doc_id), modulus, remainder)
    docs = df.select(F.col(doc_id).alias("doc_id"), held.alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = docs.select("text").mapInArrow(count_frequent, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    model = PairModel(docs, counts)
    sums = materialise(model.documents().withColumnsRenamed({"base": "base_score", "lp": "score"}), "lm-scores")
    model.close()
    return sums.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textcodes.mix(u.view(np.uint64)) ^ w.view(np.uint64)


def _combined(*keys: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of the key columns, in order, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return [*keys, np.zeros(0, np.int64)]
    at = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [*[k[at] for k in keys], np.diff(np.concatenate([at, [len(order)]]))]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
