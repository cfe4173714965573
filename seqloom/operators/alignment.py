"""Pairwise alignment and overlap of strings, over Arrow batches: dynamic programming that Spark has no expression for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align(query: str, target: str, mode: str = "global", match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int, int]:
    """(score, identical, columns, start, stop) of a best alignment; start and stop are the target's part.

    ``global`` aligns all of both, ``glocal`` all of the query within the target, ``local`` the best parts.
    A row at a time; a row's gaps along the target are a running maximum.
    """
    n, m = len(query), len(target)
    a, b = np.frombuffer(query.encode("utf-32-le"), "<u4"), np.frombuffer(target.encode("utf-32-le"), "<u4")
    steps = np.arange(m + 1) * gap
    free = mode in ("glocal", "local")
    table = np.zeros((n + 1, m + 1), np.int32)
    table[0] = 0 if free else steps
    for i in range(1, n + 1):
        best = table[i - 1] + gap
        best[1:] = np.maximum(best[1:], table[i - 1, :-1] + np.where(b == a[i - 1], match, mismatch))
        if mode == "local":
            best = np.maximum(best, 0)
        table[i] = np.maximum.accumulate(best - steps) + steps
        if mode == "local":
            np.maximum(table[i], 0, out=table[i])
    if mode == "local":
        i, j = np.unravel_index(table.argmax(), table.shape)
    else:
        i, j = n, int(table[n].argmax()) if free else m
    score, stop, same, columns = int(table[i, j]), int(j), 0, 0
    while i > 0 or (j > 0 and not free):
        if mode == "local" and table[i, j] == 0:
            break
        here = table[i, j]
        if i > 0 and j > 0 and here == table[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            same += int(a[i - 1] == b[j - 1])
            i, j = i - 1, j - 1
        elif i > 0 and here == table[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
        columns += 1
    return score, same, columns, int(j), stop


def best_overlap(left: str, right: str, least: int = 8, most_wrong: float = 0.1) -> int:
    """Length of the longest overlap of the end of ``left`` with the start of ``right`` with few enough mismatches; 0 for none."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (left, right))
    for n in range(min(len(a), len(b)), least - 1, -1):
        if (a[len(a) - n :] != b[:n]).sum() <= most_wrong * n:
            return n
    return 0


def aligned(pairs: DataFrame, query: str, target: str, mode: str = "global", match: int = 1, mismatch: int = -1, gap: int = -1) -> DataFrame:
    """Adds ``score, identity, start, stop``; identity is identical columns over columns. Null strings give nulls."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in (query, target)}
            found = [None if q is None or t is None else align(q, t, mode, match, mismatch, gap) for q, t in zip(batch.column(at[query]).to_pylist(), batch.column(at[target]).to_pylist(), strict=True)]
            more = {
                "score": pa.array([f and f[0] for f in found], pa.int32()),
                "identity": pa.array([f and (f[1] / f[2] if f[2] else 0.0) for f in found], pa.float64()),
                "start": pa.array([f and f[3] for f in found], pa.int32()),
                "stop": pa.array([f and f[4] for f in found], pa.int32()),
            }
            yield pa.RecordBatch.from_pydict({**dict(zip(names, batch.columns, strict=True)), **more})

    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.IntegerType()), T.StructField("identity", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    return pairs.mapInArrow(run, schema)


def merged_mates(pairs: DataFrame, one: str = "one", two: str = "two", least: int = 8, most_wrong: float = 0.1) -> DataFrame:
    """Adds ``overlap`` and ``merged``: the first mate and the reverse complement of the second where they overlap, else null."""
    from seqloom.functions.sequence import reverse_complement

    turned = pairs.withColumn("_rc", reverse_complement(F.col(two)))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(batch.schema.get_field_index(one)).to_pylist()
            b = batch.column(batch.num_columns - 1).to_pylist()
            n = [best_overlap(x, y, least, most_wrong) if x and y else 0 for x, y in zip(a, b, strict=True)]
            joined = [x + y[k:] if k else None for x, y, k in zip(a, b, n, strict=True)]
            yield pa.RecordBatch.from_pydict({**dict(zip(names, batch.columns[:-1], strict=True)), "overlap": pa.array(n, pa.int32()), "merged": pa.array(joined, pa.string())})

    return turned.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("overlap", T.IntegerType()), T.StructField("merged", T.StringType())]))


def seed_pairs(queries: DataFrame, targets: DataFrame, k: int, least: int) -> DataFrame:
    """``(query_id, target_id, seeds, query, target)`` of pairs ``(id, bases)`` that share enough distinct k-mers: the candidates to align."""
    from seqloom.functions.sequence import kmers

    q = queries.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(kmers(F.col("bases"), k))).alias("kmer"))
    r = targets.select(F.col("id").alias("target_id"), F.explode(F.array_distinct(kmers(F.col("bases"), k))).alias("kmer"))
    met = q.join(r, "kmer").groupBy("query_id", "target_id").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= least)
    return met.join(queries.select(F.col("id").alias("query_id"), F.col("bases").alias("query")), "query_id").join(targets.select(F.col("id").alias("target_id"), F.col("bases").alias("target")), "target_id")
