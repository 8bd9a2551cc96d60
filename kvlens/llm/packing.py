"""Cost-balanced packing of documents into token sequences.

A document is its token ids and a closing id.  What fills whole sequences is
cut off and forms sequences of its own; the rest of each document, shorter
than a sequence, waits in a shard of ``SHARD`` documents.  A shard of ``T``
tokens gets ``ceil(T / capacity)`` sequences, the last as short as the tokens
need, so that at most one sequence of a shard is padded.  Its documents go in
descending order of length to the sequence of the lowest cost among those
with room for them; the cost of a sequence is the sum over its pieces of
``linear * n + quadratic * n * n`` (attention stays within a piece).  A
document that fits nowhere whole is cut: the lowest-cost sequence with any
room takes what fits, and the rest queues again by its length.

Shards are runs of rows in one task, so packing needs no shuffle; a retried
task makes the same sequences under the same ids (partition and count).

Token ids come from a table of distinct chunks per task: the pre-tokeniser
never joins a character with a space or newline after it, so a text is cut
there and each chunk's ids are looked up.  Chunks are encoded by tiktoken with
the vocabulary of the given tokenizers file, which is several times faster on
short strings; every task compares both libraries on its first texts.

Defined cases: a null or empty text is the closing id alone; repeated rows
are packed once each; a very long text is cut into sequences as it comes.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = 4096  # documents balanced against each other
TABLE = 1_000_000  # distinct chunks that a task's table holds before it starts anew
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level pre-tokeniser


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class ByteBpe(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut, self.odd = re.compile(r"(?<=\S)(?=[ \n])"), re.compile(r"\s[ \n]")
        self.checked = 0

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        self[chunk] = ids = packed(self.bpe.encode_ordinary(chunk if chunk[:1] == "\n" else " " + chunk))
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or self.odd.search(text):  # runs of white space stay with what follows them
            first, *rest = self.cut.split(text)
            found = (self[c] if c[0] == "\n" else packed(self.bpe.encode_ordinary(c)) if c[1:2] == "\n" else self[c[1:]] for c in rest)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
            found = map(self.__getitem__, rest)
        return self._check(text, self._plain(first) + b"".join(found))

    def _plain(self, chunk: str) -> bytes:
        return packed(self.bpe.encode_ordinary(chunk))

    def _check(self, text: str, out: bytes) -> bytes:
        if self.checked < 20 and len(text) < 20_000:
            self.checked += 1
            if packed(self.full.encode(text, add_special_tokens=False).ids) != out:
                raise ValueError("this tokenizer file is no byte-level BPE with the usual pre-tokeniser")
        return out


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard."""
    total = sum(lengths)
    if not total:
        return []
    n = -(-total // capacity)
    free = np.full(n, capacity, np.int64)
    free[-1] = total - (n - 1) * capacity
    cost, filled, out = np.zeros(n), np.zeros(n, np.int64), []
    queue = [(-x, i, 0) for i, x in enumerate(lengths) if x]
    heapq.heapify(queue)
    while queue:
        x, i, start = heapq.heappop(queue)
        x = -x
        room = free >= x
        if not room.any():
            room = free > 0
        s = int(np.where(room, cost, np.inf).argmin())
        size = min(x, int(free[s]))
        out.append((i, start, size, s, int(filled[s])))
        free[s] -= size
        filled[s] += size
        cost[s] += linear * size + quadratic * size * size
        if size < x:
            heapq.heappush(queue, (size - x, i, start + size))
    return out


def pack_documents(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, closing: int = 0,
    linear: float = 1.0, quadratic: float = 1 / 24576, ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``, and with ``ids`` the ids."""
    src = df.select(doc_id, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([src.schema[0], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer)
        last, made, rows = packed([closing]), TaskContext.get().partitionId() << 32, []
        rest: list[tuple[object, int, bytes, int]] = []  # document, where its rest begins, ids of the rest, all its tokens

        def put(doc, start, buf, tokens, sequence, offset):
            row = (doc, start, len(buf) // 4, zlib.crc32(buf), tokens, sequence, offset)
            rows.append((*row, np.frombuffer(buf, "<u4").tolist()) if ids else row)

        def close() -> int:
            pieces = balance([len(r[2]) // 4 for r in rest], capacity, linear, quadratic)
            for i, start, size, sequence, offset in pieces:
                doc, at, buf, tokens = rest[i]
                put(doc, at + start, buf[4 * start : 4 * (start + size)], tokens, made + sequence, offset)
            rest.clear()
            return made + 1 + max((p[3] for p in pieces), default=-1)

        def batch_of(found: list) -> pa.RecordBatch:
            cols = [*zip(*found)]
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[7], pa.list_(pa.int64()))] if ids else [])], names=schema.fieldNames())

        id_type = None
        gc.disable()  # a large table without cycles
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                buf = bpe.encode(t.as_py() or "") + last
                tokens = len(buf) // 4
                whole = tokens // capacity
                for k in range(whole):
                    put(doc, k * capacity, buf[4 * k * capacity : 4 * (k + 1) * capacity], tokens, made, 0)
                    made += 1
                if tokens % capacity:
                    rest.append((doc, whole * capacity, buf[4 * whole * capacity :], tokens))
                if len(rest) >= SHARD:
                    made = close()
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows.clear()
        close()
        if rows:
            yield batch_of(rows)
        gc.enable()

    return src.mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
