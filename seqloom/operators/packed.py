"""K-mers as 64-bit numbers, two bits a symbol, for k up to 31.

Packing runs over Arrow batches: whole batches of reads at a time, and what can be counted in a batch
is counted there, so what is shuffled are numbers with counts, never a string a k-mer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2


def packed(texts: pa.Array, k: int, canonical: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, positions) of the k-mers of A, C, G and T; ``canonical`` takes the larger strand. Nulls have none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    code = _CODE[raw]
    n = len(code) - k + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts = ends - ends[0]
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    bad = np.r_[0, np.cumsum(code == 4)]
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (row[:n] == row[k - 1 :]))
    clean = np.where(code == 4, 0, code).astype(np.int64)

    def joined(symbols: np.ndarray) -> np.ndarray:
        """Keys at all places, by doubling: runs of 1, 2, 4 and more symbols put together."""
        out, done, power, width = np.zeros(n, np.int64), 0, symbols, 1
        left = k
        while left:
            if left & 1:
                out = (out << (2 * width)) | power[done : done + n]
                done += width
            left >>= 1
            if left:
                power = (power[:-width] << (2 * width)) | power[width:]
                width *= 2
        return out

    keys = joined(clean)[at]
    if canonical:
        back = joined(3 - clean[::-1])[::-1]  # place i from the end is the other strand of place i
        keys = np.maximum(keys, back[at])
    return keys, row[at], at - starts[row[at]]


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``most`` symbols, so that what is made of one is bounded, however long a batch's texts are; a longer row is a piece of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    ends, done = np.cumsum(sizes), 0
    while done < len(sizes):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
        yield batch.slice(done, stop - done)
        done = stop


def counts(reads: DataFrame, bases: str, k: int, canonical: bool = False, by: str | None = None, least: int = 1) -> DataFrame:
    """``(key, n)``, with ``by`` counted for each of its values: counted in each batch before the shuffle."""
    names = [by] if by else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, 0)):
            keys, rows, _ = packed(batch.column(0), k, canonical)
            if by is None:
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": found, "n": n})
            else:
                group = batch.column(1).dictionary_encode()
                which = np.asarray(pc.fill_null(group.indices, -1))[rows]
                for value in np.unique(which):
                    found, n = np.unique(keys[which == value], return_counts=True)
                    named = pa.repeat(group.dictionary[int(value)] if value >= 0 else pa.scalar(None, batch.column(1).type), len(found))
                    yield pa.RecordBatch.from_arrays([named, pa.array(found), pa.array(n)], names=[by, "key", "n"])

    fields = [reads.schema[by]] if by else []
    schema = T.StructType([*fields, T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    out = reads.select(bases, *names).mapInArrow(run, schema).groupBy(*names, "key").agg(F.sum("n").alias("n"))
    return out.filter(F.col("n") >= least) if least > 1 else out


def placed(reads: DataFrame, id_column: str, bases: str, k: int, canonical: bool = False) -> DataFrame:
    """``(id, pos, key)``, pos from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, 1)):
            keys, rows, places = packed(batch.column(1), k, canonical)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(places.astype(np.int32)), pa.array(keys)], names=[id_column, "pos", "key"])

    schema = T.StructType([reads.schema[id_column], T.StructField("pos", T.IntegerType()), T.StructField("key", T.LongType())])
    return reads.select(id_column, bases).mapInArrow(run, schema)


def of_reads(reads: DataFrame, id_column: str, bases: str, k: int, canonical: bool = False) -> DataFrame:
    """``(id, key, n)``: how often each k-mer is in each read; a read is counted in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, 1)):
            keys, rows, _ = packed(batch.column(1), k, canonical)
            order = np.lexsort((keys, rows))
            keys, rows = keys[order], rows[order]
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[first])), pa.array(keys[first]), pa.array(np.diff(np.r_[first, len(keys)]))], names=[id_column, "key", "n"])

    schema = T.StructType([reads.schema[id_column], T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    return reads.select(id_column, bases).mapInArrow(run, schema)


def read_depth(of: DataFrame, id_column: str, counted: DataFrame) -> DataFrame:
    """``(id, depth)``: the lower median of the counts of a read's k-mers, from ``of_reads`` and ``counts``."""
    depths = of.withColumnRenamed("n", "_m").join(counted, "key").groupBy(id_column, "n").agg(F.sum("_m").alias("_m"))
    listed = depths.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("n", "_m"))).alias("_all"), F.sum("_m").alias("_total"))
    middle = F.floor((F.col("_total") + 1) / 2)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("depth"))
    found = F.aggregate("_all", start, lambda s, x: F.struct((s["seen"] + x["_m"]).alias("seen"), F.coalesce(s["depth"], F.when(s["seen"] + x["_m"] >= middle, x["n"])).alias("depth")))
    return listed.select(id_column, found["depth"].alias("depth"))
