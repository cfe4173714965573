"""Binary alignments: BGZF blocks of packed records, decoded over Arrow batches.

A file is one task's work, as its blocks can't be found without reading it; many
files are many tasks. Records are decoded as the stream is unpacked, so only the
packed file is held.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
CIGAR_OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
TAG_SIZES = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            code, size = TAG_SIZES[sub]
            numbers = struct.unpack_from(f"<{n}{code}", raw, at + 5)
            value, at = ",".join([sub, *map(str, numbers)]), at + 5 + n * size
        else:
            code, size = TAG_SIZES[kind]
            found = struct.unpack_from(f"<{code}", raw, at)[0]
            value, at = found.decode() if kind == "A" else str(found), at + size
            kind = kind if kind in "Af" else "i"
        out[f"{name}:{kind}"] = value
    return out


def records(packed: bytes) -> Iterator[tuple]:
    """The fields of each record, coordinates from 1 as in the text form."""
    with gzip.open(io.BytesIO(packed)) as stream:
        if stream.read(4) != b"BAM\1":
            raise ValueError("not a BAM file")
        stream.read(struct.unpack("<I", stream.read(4))[0])
        names = []
        for _ in range(struct.unpack("<I", stream.read(4))[0]):
            names.append(stream.read(struct.unpack("<I", stream.read(4))[0])[:-1].decode())
            stream.read(4)
        while len(head := stream.read(4)) == 4:
            raw = stream.read(struct.unpack("<I", head)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHIiii", raw)
            at = 32 + l_name
            name = raw[32 : at - 1].decode()
            ops = struct.unpack_from(f"<{n_cigar}I", raw, at)
            at += 4 * n_cigar
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in raw[at : at + (l_seq + 1) // 2])[:l_seq]
            at += (l_seq + 1) // 2
            qual = raw[at : at + l_seq]
            shown = "*" if not l_seq or qual[0] == 0xFF else "".join(chr(q + 33) for q in qual)
            rname = names[ref] if ref >= 0 else "*"
            rnext = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
            yield name, flag, rname, pos + 1, mapq, "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops) or "*", rnext, next_pos + 1, tlen, seq or "*", shown, _tags(raw[at + l_seq :])


def read_bam(spark: SparkSession, path: str | list[str], rows: int = 4096) -> DataFrame:
    """The columns of ``read_sam``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def made(part: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*part, strict=True))
            columns[-1] = [list(m.items()) for m in columns[-1]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                part = []
                for record in records(content.as_py()):
                    part.append(record)
                    if len(part) == rows:
                        yield made(part)
                        part = []
                if part:
                    yield made(part)

    return files.mapInArrow(decode, SCHEMA)
