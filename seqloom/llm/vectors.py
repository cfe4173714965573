"""Vectors in packed blocks, and query blocks against them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import partitions

#: Vectors of a packed block and queries of a query block, about.
BLOCK, QUERIES = 8192, 512


def usable(df: DataFrame, id_column: str, vector_column: str, zero_too: bool) -> DataFrame:
    """``(vec_id, v array<double>, dim)`` without null ids and vectors, nulls and non-finite components, and zero vectors unless asked for."""
    v = F.col(vector_column).cast("array<double>")
    plain = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    plain = plain.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))  # not for NaN, which is the largest
    if not zero_too:
        plain = plain.filter(F.exists("v", lambda x: x != 0))
    return plain.withColumn("dim", F.size("v"))


def packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """``(dim, block, ids, vecs)``: each block's ids in order and its doubles, as bytes. Blocks by hash are even."""
    placed = vectors.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["vec_id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((*flat.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vecs": pa.array([flat[order].tobytes()], pa.binary())})

    return placed.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, vecs binary")


def search(index: DataFrame, blocks: int, queries: DataFrame, n_queries: int, make: Callable[[], tuple[Callable, Callable]], k: int, kind: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best over all blocks of its dimension.

    ``index`` has columns dim, block, ids and the payloads a, b, c; ``make()`` gives two functions: of
    ``(dim, ids, a, b, c)`` to an opened block, and of ``(opened block, query ids, query matrix)`` to arrays
    ``(query_id, vec_id, score)`` with each query's best of the block. Blocks of queries are sent to every
    index block of their dimension. A task reads an index block once, ahead of the query blocks sent to it,
    and holds that one and a query block at a time. Each query meets each vector: the work is their product.
    """
    parts = max(1, -(-n_queries // QUERIES))
    none = F.lit(None).cast("binary")
    held = index.select("dim", "block", F.lit(-1).alias("part"), "ids", "a", "b", "c")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to_block")
    asked = packed(queries, parts).select("dim", F.col("block").alias("part"), "ids", "vecs", every).select("dim", F.col("to_block").alias("block"), "part", "ids", F.col("vecs").alias("a"), none.alias("b"), none.alias("c"))
    rows = held.union(asked).repartition(partitions(index.sparkSession), "dim", "block").sortWithinPartitions("dim", "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, best = make()
        at = opened = None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, block, part, ids, *payload = (column[i].as_py() for column in batch.columns)
                if part < 0:
                    at, opened = (dim, block), opening(dim, ids, *payload)
                elif at == (dim, block):  # no vector has the query's dimension and hash otherwise
                    q = np.frombuffer(payload[0], np.float64).reshape(-1, dim)
                    asked, found, score = best(opened, np.frombuffer(ids, np.int64), q)
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_count(n: int) -> int:
    return max(1, -(-n // BLOCK))
