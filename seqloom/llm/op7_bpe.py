"""Byte-level BPE encoding and decoding with the tokenizers library.

Ranks come from a public file whose path is a parameter. Each match of the
split pattern is encoded by itself: bytes are written as the usual printable
stand-in characters, merged by the library's BPE model and read back. Decoding
reverses the byte table, so characters split between tokens come out whole.

Defined results: a null text counts as empty; an empty text has no tokens;
rows are handled one by one, so ties, repeated rows, empty tables and further
columns change nothing. Texts of any length are split in bounded pieces of
matches, never cut.
"""

from __future__ import annotations

import base64
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import map_batches, table, texts_of

#: Matches whose ids a worker remembers before it starts over.
REMEMBERED = 500_000
#: Matches handled at once.
AT_ONCE = 200_000


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class ByteBpe:
    """Encoder and decoder of one ranks file."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import models

        ranks = read_ranks(path)
        shown = byte_characters()
        written = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [(written[t[:i]], written[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.matches = regex.compile(pattern)
        self.model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.shown = dict(enumerate(shown))
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known = {}
        tokenize, shown = self.model.tokenize, self.shown
        for piece in pieces:
            ids = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(shown))]
            self.known[piece] = pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= 4 * AT_ONCE:
            return self._pieces(self.matches.findall(text))
        found, out = (m[0] for m in self.matches.finditer(text)), []
        while pieces := list(islice(found, AT_ONCE)):
            out.append(self._pieces(pieces))
        return b"".join(out)

    def _pieces(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            fresh = {p for p in pieces if p not in self.known}
            if len(self.known) + len(fresh) > REMEMBERED:
                fresh = set(pieces)
            self._learn(fresh)
            return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Of each token the characters it touches; a character split between tokens is in the span of each."""
        raw, at, spans = text.encode(), 0, []
        char_of = np.cumsum([(b & 0xC0) != 0x80 for b in raw]) - 1
        for i in np.frombuffer(self.encode(text), "<u4").tolist():
            end = at + len(self.bytes_of[i])
            spans.append((int(char_of[at]), int(char_of[end - 1]) + 1))
            at = end
        return spans


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``(id, ids binary[, decoded binary][, spans array<struct<start,end>>])``, one row a row."""

    def make():
        own = ByteBpe(path or _default()[0], pattern or _default()[1])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            ids = [own.encode(t) for t in texts]
            columns = {id_column: batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([own.decode(x) for x in ids], pa.binary())
            if offsets:
                columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in own.offsets(t)] for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_pydict(columns)

        return run

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.BinaryType())])
    if decoded:
        schema = schema.add("decoded", T.BinaryType())
    if offsets:
        schema = schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    return map_batches(docs.select(id_column, F.col(text_column).cast("string")), make, schema, rows=64)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, decoded binary)``."""

    def make():
        table_of = {r: t for t, r in read_ranks(path or _default()[0]).items()}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [b"".join(map(table_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_pydict({id_column: batch.column(0), "decoded": pa.array(out, pa.binary())})

        return run

    schema = T.StructType([T.StructField(id_column, encoded.schema[id_column].dataType), T.StructField("decoded", T.BinaryType())])
    return map_batches(encoded.select(id_column, ids_column), make, schema, rows=64)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the ids and of what they decode to."""
    return encode(docs, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
