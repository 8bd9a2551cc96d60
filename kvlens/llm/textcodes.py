"""Words of a batch of texts as numpy arrays, read straight from Arrow buffers.

A word is a run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``, with A-Z
lower-cased; as those bytes are ASCII, UTF-8 bytes give the same words as
characters do.  A word is known by a 64-bit hash of its bytes: per byte a
random 64-bit value times a power of an odd number, summed modulo 2**64 and
mixed (two different words share a hash with a chance of about 2**-60).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

SLICE_BYTES = 1 << 20  # text handled at a time by the array code; more takes an executor close to its memory

_rng = np.random.default_rng(20240607)
_SUBST = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SUBST = _SUBST[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


END = int(mix(np.array([0x454E44], np.uint64)).view(np.int64)[0])  # the token that ends a text


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of ``column``; one
    longer text is a run of its own."""
    _, offs = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more at the end); a
    null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the first word of each text (one more at the end)."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(apart[data], out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    begins = np.flatnonzero(begins)
    return begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, offs)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, p in (("up", _P), ("down", _P_INV)):
            v = np.full(size, p, np.uint64)
            v[0] = 1
            _POWERS[name] = np.cumprod(v, dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(int(np.searchsorted(ends, begins[i] + SLICE_BYTES, "right")), i + 1)
        a, z = int(begins[i]), int(ends[j - 1])
        up, down = _powers(z - a + 1)
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_SUBST[data[a:z]] * up[: z - a], out=total[1:])
        b, e = begins[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(_P))
        i = j
    return out


def rolling(h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``begins`` to ``ends`` of a sequence of hashes, by its place in none."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(_P))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the first word of each text (one more at the end)."""
    data, offs = buffers(texts)
    begins, ends, first = word_spans(data, offs)
    return word_hashes(data, begins, ends), first


cloudpickle.register_pickle_by_value(sys.modules[__name__])
