"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null identifier inside the operators.
NULL_ID = -(2**63)

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set a local master gets a temporary one; on a cluster no machine-local folder would do, so that raises."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is none of ``taken``."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def whole_rows(docs: DataFrame) -> DataFrame:
    """``(row, id, text_hash)``: each row packed in a struct, so that no column of its can clash, and what tells it from others.

    Ids can be null or stand for several texts, so a row is known by its id (``NULL_ID`` for null) and a hash of its text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), row_id().alias("id"), text_hash().alias("text_hash"))


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


#: Keys with fewer rows than this are never worth spreading.
HOT_ROWS = 2048


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key, where a few keys (or null) may hold most rows of ``left``.

    The keys with most rows, one a partition at most, are known from counts (``counts(key, n)``, made here if
    not given); their rows of ``left`` are dealt over all partitions, and their rows of ``right`` copied to each.
    Both sides are read more than once and should be checkpointed. Column names must not clash.
    """
    n = partitions(left.sparkSession)
    if counts is None:
        counts = left.groupBy(F.col(left_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") > HOT_ROWS).select(F.xxhash64("key").alias("h"), "n").orderBy(F.col("n").desc(), "h").limit(n).collect()  # one a partition
    match = F.col(left_key) == F.col(right_key)
    if not top:
        return left.join(right, match, how)
    hot = [r.h for r in top]
    salt = F.when(F.xxhash64(left_key).isin(hot), F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int")).otherwise(0)
    copies = F.when(F.xxhash64(right_key).isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.withColumn("_left_salt", salt)
    copied = right.withColumn("_right_salt", F.explode(copies))
    return dealt.join(copied, match & (F.col("_left_salt") == F.col("_right_salt")), how).drop("_left_salt", "_right_salt")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, the own row included, over all rows in order: partial sums of range partitions first, so no task sees all rows."""
    n = partitions(df.sparkSession)
    placed = checkpoint(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    upto = W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)  # over a row a partition
    before = placed.groupBy(F.col("_part").alias("_of")).agg(*[F.sum(c).alias(f"_b_{k}") for k, c in sums.items()])
    before = before.select("_of", *[F.coalesce(F.sum(f"_b_{k}").over(upto), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.join(F.broadcast(before), F.col("_part") == F.col("_of"))  # a row a partition
    return out.select(*df.columns, *[(F.sum(c).over(own) + F.col(f"_b_{k}")).alias(k) for k, c in sums.items()])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str, rows: int = 512) -> DataFrame:
    """mapInArrow with ``make()`` called once a task; batches are cut to ``rows`` rows so long texts stay bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 20, 50)  # texts split into many strings hold no cycles
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; a null is the empty text."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, np.uint64)
            p[0] = 1
            q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            q[0] = 1
            _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``words[start:end]``, from prefix sums of a polynomial."""
    with np.errstate(over="ignore"):
        p, q = _powers(len(words) + 1)
        prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * p[: len(words)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * q[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    at = np.arange(max(0, len(words) - k + 1))
    return span_hashes(words, at, at + k)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)``, root the least node of the component.

    Least labels move along edges and labels then jump to the label of their
    label, so the number of rounds grows with the logarithm of the diameter on
    the usual shapes. Nodes with many neighbours and labels of large components are
    spread over all partitions. Each round is cut by a checkpoint; only a count of
    moved labels comes to the driver.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = checkpoint(both.groupBy(F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = checkpoint(labels)
    for _ in range(limit):
        near = spread_join(both, labels, "b", "node", counts=degrees).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        step = checkpoint(labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("to")))
        jump = labels.select(F.col("node").alias("k"), F.col("root").alias("far"))
        step = checkpoint(spread_join(step, jump, "to", "k", "left").select("node", "old", F.least("to", "far").alias("root")))
        moved = step.filter(F.col("old") != F.col("root")).limit(1).count()
        labels = step.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
