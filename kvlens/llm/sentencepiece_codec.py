"""SentencePiece ids and back, from a table of distinct chunks.

No piece of the model holds a whitespace marker after another character, so
no merge crosses from a character to a following marker, and none holds a
newline.  A text is therefore cut before each marker that follows another
character, and before each newline; each distinct chunk is segmented once per
task by the sentencepiece library, and the ids are joined back by position.  The table lives in one task: a table over the
whole corpus would have to be joined by (document, position), which shuffles
several times the input, while a text meets most of its chunks in the same
task anyway.  It is emptied at ``TABLE`` chunks so that memory is bounded;
results do not depend on it.

Both the pieces and the normaliser are checked when a task starts; a model
whose pieces cross markers, or whose normaliser changes characters or drops
whitespace, encodes whole texts instead (the same results, slower).

Defined cases: a null text counts as empty, an empty text has no ids and
decodes to an empty text; repeated rows give repeated results; of the input's
columns only ``keep`` are returned.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE = 600_000  # distinct chunks that a task's table holds before it starts anew
MARK = "▁"


class ChunkEncoder:
    """Encodes texts exactly as ``SentencePieceProcessor.encode`` does."""

    def __init__(self, model: str, table: int = TABLE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        #: chunk -> its ids as decimals joined by commas, what they decode to, their number
        self.limit, self.table = table, {}
        n = self.sp.get_piece_size()
        self.names = [*map(str, range(n))]
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        for i in range(n):
            if self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i):
                self.pieces[i] = "\0\0"  # equal to no text
        plain = [self.sp.id_to_piece(i) for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        probe = "a  b ½Ａ\t　\n c "
        marked = "".join(self.sp.encode(probe, out_type=str))
        kept = marked.startswith(MARK + "a" + 2 * MARK + "b" + MARK) and marked.endswith("c" + MARK) and self.sp.decode(self.sp.encode(probe)) == probe
        self.local = kept and len(self.sp.encode("\n")) == 2 and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        self.cut = re.compile(r"(?<=[^ ▁])(?=[ ▁])|(?=\n)")

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Per text its ids as decimals joined by commas, what they decode to, and their number."""
        if not self.local:
            return [(",".join(map(str, x)), self.sp.decode(x) if x else "", len(x)) for x in self.sp.encode(texts, num_threads=1)]
        out = []
        for run in self._runs(texts):
            cut = [self._chunks(t) if t else [] for t in run]
            new = {c for cs in cut for c in cs}.difference(self.table)
            if len(self.table) + len(new) > self.limit:
                self.table = {}
                new = {c for cs in cut for c in cs}
            self._add(list(new))
            get = self.table.__getitem__
            for cs in cut:
                found = [*map(get, cs)]
                out.append((",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:], sum([x[2] for x in found])))
        return out

    def _add(self, new: list[str]) -> None:
        """Segments distinct chunks and decodes their ids; what they decode to
        begins with the marker's space, or with the newline."""
        marker, piece, decode = [self.sp.piece_to_id(MARK)], self.pieces, self.sp.decode
        for c, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            if c[:1] == "\n":
                ids, space, plain = ids[1:], "", MARK + c  # the library puts a marker first
            else:
                ids, space, plain = ids or marker, " ", MARK + c
            # Ordinary pieces decode to themselves; others (bytes) are left to the library.
            text = space + c.replace(MARK, " ") if "".join([piece[i] for i in ids]) == plain.replace(" ", MARK) else space + decode(ids)
            self.table[c] = ",".join([self.names[i] for i in ids]), text, len(ids)

    def _runs(self, texts: list[str]) -> Iterator[list[str]]:
        """Texts in runs of about a million characters."""
        run, n = [], 0
        for t in texts:
            run.append(t)
            n += len(t)
            if n > 1_000_000:
                yield run
                run, n = [], 0
        if run:
            yield run

    def _chunks(self, text: str) -> list[str]:
        """Chunks without the marker that each begins with (the library puts
        one before the first), or from a newline on."""
        if MARK in text or "  " in text or " \n" in text or text[0] in " \n":  # runs of markers stay with what follows them
            return [c if c[0] == "\n" else c[1:] for c in self.cut.split(" " + text) if c]
        return text.replace("\n", " \n").split(" ")


def encode_documents(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Per row: ``keep``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined
    by commas), ``decoded_sha256`` (of the decoded text), and with ``ids`` the
    ids and the decoded text themselves."""

    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            gc.disable()  # a large table of tuples without cycles
            found = coder.encode(texts)
            gc.enable()
            cols = [batch.column(i) for i in range(len(names))]
            cols += [pa.array([n for _, _, n in found], pa.int64())]
            cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x, _, _ in found], pa.string())]
            cols += [pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d, _ in found], pa.string())]
            if ids:
                cols += [pa.array([[int(i) for i in x.split(",") if i] for x, _, _ in found], pa.list_(pa.int32())), pa.array([d for _, d, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    src = df.select(*names, F.col(text).cast("string").alias("__text"))
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    schema = T.StructType([*src.drop("__text").schema.fields, *T._parse_datatype_string(more).fields])
    return src.mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
