"""Orders, merges of sorted inputs, samples by count, bases and length, and recalibration tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.graphs import cut
from seqloom.operators.rows import numbered


def hash_number(key: Column, seed: int = 0) -> Column:
    """A number of 32 bits from the MD5 of the key and a seed: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long")


def natural(name: Column) -> list[Column]:
    """Names by their text up to the last number, then that number, then whole."""
    return [F.regexp_extract(name, r"^(.*?)\d*$", 1), F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(-1)), name]


def by_list(rows: DataFrame, names: DataFrame, name: str, out: str = "place") -> DataFrame:
    """Rows numbered by a list's order ``(name, ordinal)``; those that aren't in it come last, by name."""
    joined = rows.join(names.select(F.col("name").alias("_name"), "ordinal"), F.col(name) == F.col("_name"), "left")
    return numbered(joined, [F.col("ordinal").asc_nulls_last(), F.col(name)], out).drop("_name", "ordinal")


def merged(parts: list[DataFrame], order: list[Column], out: str = "place") -> DataFrame:
    """Sorted inputs as one sorted table with places: one range-partitioned sort, however many parts."""
    return numbered(reduce(DataFrame.unionByName, parts), order, out)


def shuffled(rows: DataFrame, key: Column, seed: int = 0, out: str = "place") -> DataFrame:
    """A random order that reruns repeat."""
    return numbered(rows, [hash_number(key, seed), key], out)


def running_sum(rows: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over the rows before, in order: by range partitions, so no task holds all rows."""
    placed = cut(rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_p").agg(F.sum("_v").alias("_s"))
    before = sums.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    inside = F.coalesce(F.sum("_v").over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(out, inside + F.col("_before")).drop("_p", "_q", "_v", "_before")


def sample_bases(rows: DataFrame, key: Column, length: Column, target: int, seed: int = 0) -> DataFrame:
    """Rows in random order until their lengths reach the target, the one that reaches it included."""
    return running_sum(rows, [hash_number(key, seed), key], length, "_sum").filter(F.col("_sum") < target).drop("_sum")


def longest_first(rows: DataFrame, key: Column, length: Column, target: int) -> DataFrame:
    """The longest rows until their lengths reach the target."""
    return running_sum(rows, [length.desc(), key], length, "_sum").filter(F.col("_sum") < target).drop("_sum")


def upsample(rows: DataFrame, key: Column, target: int, seed: int = 0) -> DataFrame:
    """Exactly ``target`` rows, ``copy`` from 0: each as often as it goes into it, and once more those first in random order."""
    n = rows.count()
    if not n:
        return rows.withColumn("copy", F.lit(0))
    each, more = divmod(target, n)
    placed = numbered(rows, [hash_number(key, seed), key], "_place")
    times = F.lit(each) + (F.col("_place") < more).cast("int")
    return placed.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).drop("_place")


def quality_matrix(observed: DataFrame, keys: list[str], wrong: Column, least: int = 1) -> DataFrame:
    """``(keys, total, wrong, quality)``: what a claimed quality (with further keys such as the place) comes to, one error added; below ``least`` rows the claim stays."""
    sums = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.sum(wrong.cast("long")).alias("wrong"))
    found = F.round(-10 * F.log10((F.col("wrong") + 1) / (F.col("total") + 2))).cast("int")
    return sums.withColumn("quality", F.when(F.col("total") >= least, F.greatest(found, F.lit(2))))


def recalibrated(rows: DataFrame, matrix: DataFrame, keys: list[str], claimed: str) -> DataFrame:
    """Rows with ``claimed`` replaced by the matrix's quality where it has one."""
    table = matrix.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("quality").alias("_quality"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    return rows.join(table, match, "left").withColumn(claimed, F.coalesce("_quality", claimed)).drop("_quality", *[f"_{k}" for k in keys])


def filter_counts(rows: DataFrame, filters: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """``(filter, dropped, weight)``: what each filter of an ordered chain drops of what the ones before have left, in one pass; ``kept`` last."""
    first = F.lit("kept")
    for name, keep in reversed(filters.items()):
        first = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(first)
    return rows.groupBy(first.alias("filter")).agg(F.count(F.lit(1)).alias("dropped"), F.sum(weight if weight is not None else F.lit(0)).alias("weight"))
