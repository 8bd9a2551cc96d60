"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last may be shorter);
every passage of the whole text is encoded as shares of character and word
kinds (letters by case, digits, symbols, marks, repeated words and so on) and
passed through a small layer ``h = tanh(W x + b)``.  Gated attention,
``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages of a document, and the
weighted sum of their ``h`` gives the score, the probability of label 1.

The model is fitted on the driver, on at most ``max_train`` labelled documents (those of
the smallest hashes of their ids; a document counts once), by Adam on the log-loss with both
labels weighted by the square root of their rarity.  Sums run in a fixed order, so a
fit is repeatable.  Scoring needs no shuffle: the text is read once, in tasks.

Defined cases: a null or empty text is one passage without words; its score is the
model's for it.  Labels that are null are not learnt from; without labelled
rows every score is 0.5 and, with no class to tell apart, the share of label 1 if only
one label occurs.  Repeated rows are scored each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcodes

PASSAGE, HIDDEN, GATE = 64, 16, 8


def _kinds() -> np.ndarray:
    """One row per kind of byte: does a byte belong to it?"""
    groups = [
        range(97, 123), range(65, 91), range(48, 58), b".", b",;:", b"!?", b"|", b"#$%&*@^~+=<>\\_", b"'\"()[]{}-/", range(128, 256), b"\n", b" \t\r\v\f",
    ]
    out = np.zeros((len(groups), 256), np.uint8)
    for row, g in zip(out, groups):
        row[list(g)] = 1
    return out


KINDS = _kinds()
N_FEATURES = len(KINDS) + 9


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage (one more at the end)."""
    data, offs = textcodes.buffers(texts)
    begins, ends, first = textcodes.word_spans(data, offs)
    n_words = np.diff(first)
    per = np.maximum(-(-n_words // PASSAGE), 1)
    bag = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(texts)), per)
    word = first[:-1][text] + PASSAGE * (np.arange(bag[-1]) - bag[:-1][text])
    till = np.minimum(word + PASSAGE, first[1:][text])
    # Bytes of a passage: from its first word (a text's first passage: from the text's begin) to the next passage.
    edge = np.append(begins, len(data))
    start = np.where(word == first[:-1][text], offs[:-1][text], edge[np.minimum(word, len(begins))])
    stop = np.append(start[1:], len(data))
    size = np.maximum(stop - start, 0).astype(float)
    x = np.zeros((bag[-1], N_FEATURES))
    some = np.flatnonzero(size > 0)
    if len(some):
        for k, kind in enumerate(KINDS):
            x[some, k] = np.add.reduceat(kind[data], start[some], dtype=np.int64) / size[some]
    n = (till - word).astype(float)
    full = np.flatnonzero(n > 0)
    if len(full):
        lengths = (ends - begins).astype(float)
        hashes = textcodes.word_hashes(data, begins, ends)
        head, tail = data[begins], data[ends - 1]
        owner = np.repeat(full, (till - word)[full])
        order = np.lexsort((hashes, owner))
        same = np.zeros(len(hashes))
        same[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        marks = KINDS[7][tail] | KINDS[5][tail]
        total = lambda v: np.add.reduceat(v.astype(float), word[full])
        k = len(KINDS)
        x[full, k] = total(lengths) / n[full] / 10
        x[full, k + 1] = np.sqrt(total(lengths * lengths) / n[full]) / 10
        x[full, k + 2] = total(same) / n[full]
        x[full, k + 3] = total(lengths == 1) / n[full]
        x[full, k + 4] = total(marks) / n[full]
        x[full, k + 5] = total(KINDS[1][head]) / n[full]
        x[full, k + 6] = total(KINDS[3][tail]) / n[full]
        x[full, k + 7] = total(lengths > 14) / n[full]
    x[:, -1] = n / PASSAGE
    return x, bag


class Model:
    """Weights, and the forward pass over bags."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray, fixed: float | None = None):
        self.w, self.mean, self.scale, self.fixed = weights, mean, scale, fixed

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w, at, size = self.w, bag[:-1], np.diff(bag)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
        a = e / np.repeat(np.add.reduceat(e, at), size)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["o"] + w["c"])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(texts), self.fixed)
        return self.forward(*passages(texts))["p"]


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model({}, np.zeros(1), np.ones(1), 0.5 if len(y) == 0 else float(y[0]))
    rng, d = np.random.default_rng(seed), x.shape[1]
    w = {
        "W": rng.normal(size=(d, HIDDEN)) / np.sqrt(d), "b": np.zeros(HIDDEN), "V": rng.normal(size=(HIDDEN, GATE)) / 4, "U": rng.normal(size=(HIDDEN, GATE)) / 4,
        "a": rng.normal(size=GATE) / 3, "o": rng.normal(size=HIDDEN) / 4, "c": np.zeros(1),
    }
    model = Model(w, x.mean(0), x.std(0) + 1e-3)
    rarity = np.where(y == 1, np.sqrt(0.5 / y.mean()), np.sqrt(0.5 / (1 - y.mean())))
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            sizes = np.diff(bag)[pick]
            rows = np.concatenate([np.arange(bag[j], bag[j + 1]) for j in pick])
            own = np.concatenate([[0], np.cumsum(sizes)])
            f = model.forward(x[rows], own)
            dp = (f["p"] - y[pick]) * rarity[pick] / len(pick)
            wide = lambda q: np.repeat(q, sizes, axis=0)
            dz = dp[:, None] * w["o"]
            da = (wide(dz) * f["h"]).sum(1)
            de = f["a"] * (da - wide(np.add.reduceat(f["a"] * da, own[:-1])))
            dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * wide(dz) + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
            grad = {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ dp, "c": dp.sum(keepdims=True)}
            step += 1
            for k in w:
                g = grad[k] + decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 4000, modulus: int = 4, remainder: int = 2) -> Model:
    """Fits on the labelled documents that are not held out, ``max_train`` at most."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(~held_out(F.col("id"), modulus, remainder)).dropDuplicates(["id"])
    docs = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Ids first: texts are read for the sample alone, and a label without its document takes no place.
    ids = known.join(docs.select("id"), "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(max_train)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textcodes.slices(whole, "text") if whole.num_rows else ():
                x, bag = passages(b.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(bag * N_FEATURES, pa.int32()), pa.array(x.astype(np.float32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), flat], names=["id", "y", "x"])

    kind = docs.schema["id"].dataType.simpleString()
    found = docs.join(F.broadcast(ids), "id").select("id", "y", "text").mapInArrow(features, f"id {kind}, y int, x array<float>")  # max_train ids
    found = found.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.y", "r.x")  # one row an id, however often it is repeated
    found = sorted(found.collect(), key=lambda r: r["id"])
    bags = [np.asarray(r["x"], float).reshape(-1, N_FEATURES) for r in found]
    bag = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(int)
    return fit(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), bag, np.array([r["y"] for r in found], float))


def score_documents(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    return with_score(df.select(doc_id, F.col(text).cast("string").alias(text)), model, text).select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), modulus, remainder).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )


def with_score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` and the column ``__score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textcodes.slices(whole, text) if whole.num_rows else ():
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column(text)))], names=[*b.schema.names, "__score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__score", T.DoubleType())]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
