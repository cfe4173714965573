"""Approximate counting and its exact completions: count-min, prefilters, Bloom tables, registers of maxima, bucketed sketches, mergeable statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.orders import hash_number


def count_min(keys: DataFrame, key: str, depth: int = 3, width: int = 1 << 16, n: str | None = None) -> DataFrame:
    """``(line, cell, n)``: how much falls in each of ``width`` cells under ``depth`` hashes; of a fixed size, whatever the keys."""
    weight = F.sum(n) if n else F.count(F.lit(1))
    cells = F.array(*[F.struct(F.lit(i).alias("line"), (hash_number(F.col(key), i) % width).alias("cell")) for i in range(depth)])
    return keys.select(F.explode(cells).alias("c"), *([n] if n else [])).groupBy("c.line", "c.cell").agg(weight.alias("n"))


def estimates(keys: DataFrame, key: str, table: DataFrame, depth: int = 3, width: int = 1 << 16) -> DataFrame:
    """``(key, estimate)`` of distinct keys: the least of their cells, never below the true count. The table is of a fixed size."""
    cells = F.array(*[F.struct(F.lit(i).alias("line"), (hash_number(F.col(key), i) % width).alias("cell")) for i in range(depth)])
    asked = keys.select(key).distinct().select(key, F.explode(cells).alias("c")).select(key, "c.line", "c.cell")
    return asked.join(table, ["line", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def prefiltered_counts(keys: DataFrame, key: str, least: int, depth: int = 2, width: int = 1 << 20) -> DataFrame:
    """``(key, n)`` of keys that occur at least ``least`` times, exactly: only keys whose cell is full enough in the first line are counted."""
    cell = F.pmod(F.xxhash64(key), F.lit(width)).alias("cell")
    keys = keys.filter(F.col(key).isNotNull())
    table = keys.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("cell")
    hopeful = keys.select(key, cell).join(table, "cell", "left_semi")
    return hopeful.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def bloom_semi_join(rows: DataFrame, others: DataFrame, key: str, bits: int = 1 << 20, hashes: int = 2, include: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) one of the others'. A table of set bits lets few wrong rows through to the exact join, so most rows are not shuffled by key."""
    own = others.select(key).distinct()
    table = own.select(F.explode(F.array(*[hash_number(F.col(key), i) % bits for i in range(hashes)])).alias("bit")).distinct()
    maybe = rows
    for i in range(hashes):
        maybe = maybe.withColumn("_bit", hash_number(F.col(key), i) % bits).join(table.withColumnRenamed("bit", "_bit"), "_bit", "left_semi").drop("_bit")
    hits = maybe.select(key).join(own, key, "left_semi").distinct()
    return rows.join(hits, key, "left_semi" if include else "left_anti")


def registers(rows: DataFrame, group: str, key: Column, buckets: int = 256) -> DataFrame:
    """``(group, bucket, rank)``: the most leading zeros, plus one, of the keys' hashes in each bucket. Registers of unions are the maxima of both."""
    h, b = hash_number(key, 0), hash_number(key, 1) % buckets
    rank = F.lit(33) - F.length(F.bin(h)) + (h == 0).cast("int")
    return rows.select(group, b.alias("bucket"), rank.alias("rank")).groupBy(group, "bucket").agg(F.max("rank").alias("rank"))


def register_estimate(made: DataFrame, group: str | None, buckets: int = 256) -> DataFrame:
    """``(group, estimate)``: the harmonic mean of registers; counting empty ones while many are."""
    alpha = 0.7213 / (1 + 1.079 / buckets)
    one = made.groupBy(*([group] if group else []), "bucket").agg(F.max("rank").alias("rank")).groupBy(*([group] if group else [])).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("full"))
    empty = F.lit(buckets) - F.col("full")
    raw = F.lit(alpha * buckets * buckets) / (F.col("s") + empty)
    few = F.lit(float(buckets)) * F.log(F.lit(float(buckets)) / empty)
    return one.select(*([group] if group else []), F.when((raw <= 2.5 * buckets) & (empty > 0), few).otherwise(raw).alias("estimate"))


def bucket_sketch(rows: DataFrame, group: str, key: Column, buckets: int = 128) -> DataFrame:
    """``(group, bucket, value)``: the least hash in each bucket. Sketches of unions are the minima of both."""
    return rows.select(group, (hash_number(key, 1) % buckets).alias("bucket"), hash_number(key, 0).alias("value")).groupBy(group, "bucket").agg(F.min("value").alias("value"))


def compare_buckets(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """``(q, r, equal, both, similarity)`` of each two groups with an equal bucket."""
    x, y = a.select(F.col(group).alias("q"), "bucket", "value"), b.select(F.col(group).alias("r"), "bucket", F.col("value").alias("other"))
    met = x.join(y, "bucket").filter("q < r").groupBy("q", "r").agg(F.sum((F.col("value") == F.col("other")).cast("long")).alias("equal"), F.count(F.lit(1)).alias("both"))
    return met.filter("equal > 0").withColumn("similarity", F.col("equal") / F.col("both"))


def partial_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistics that can be put together: count, sum, sum of squares, least, most."""
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged_statistics(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """``(keys, n, mean, deviation, least, most)`` of several partial statistics."""
    rows = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares")], F.min("least").alias("least"), F.max("most").alias("most"))
    mean = F.col("sum") / F.col("n")
    return rows.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("deviation"), "least", "most")


def limited(rows: DataFrame, key: str, most: int, order: Column) -> DataFrame:
    """The first ``most`` rows of each key in order: depth held down as rows come in. Spark cuts each partition's groups before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def transition_matrix(pairs: DataFrame, expected: str, seen: str) -> DataFrame:
    """``(pos, from, to, n)`` of symbols of equally long texts."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    both = F.zip_with(letters(expected), letters(seen), lambda x, y: F.struct(x.alias("from"), y.alias("to")))
    each = pairs.filter(F.length(expected) == F.length(seen)).select(F.posexplode(both).alias("pos", "x"))
    return each.groupBy("pos", "x.from", "x.to").agg(F.count(F.lit(1)).alias("n"))


def grid_statistics(rows: DataFrame, keys: list[str], x: Column, y: Column, size: float, value: Column) -> DataFrame:
    """``(keys, gx, gy, n, mean, z)``: cells of a grid, and how far each one's mean is from those of its keys, in deviations."""
    cells = rows.groupBy(*keys, F.floor(x / size).alias("gx"), F.floor(y / size).alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    whole = cells.groupBy(*keys).agg(F.avg("mean").alias("_m"), F.stddev_pop("mean").alias("_d"))
    return cells.join(whole, keys).withColumn("z", F.when(F.col("_d") > 0, (F.col("mean") - F.col("_m")) / F.col("_d")).otherwise(0.0)).drop("_m", "_d")


def without_cells(rows: DataFrame, cells: DataFrame, keys: list[str], x: Column, y: Column, size: float) -> DataFrame:
    """Rows that don't lie in the cells ``(keys, gx, gy)``."""
    placed = rows.withColumns({"gx": F.floor(x / size), "gy": F.floor(y / size)})
    return placed.join(cells.select(*keys, "gx", "gy").distinct(), [*keys, "gx", "gy"], "left_anti").drop("gx", "gy")


def completeness(members: DataFrame, markers: DataFrame, group: str, item: str, n: str) -> DataFrame:
    """``(group, found, extra, completeness, contamination)``: the share of markers a group has, and the copies it has beyond one."""
    total = markers.select(item).distinct().count()
    own = members.join(markers.select(item).distinct(), item).groupBy(group, item).agg(F.sum(n).alias("_n"))
    sums = own.groupBy(group).agg(F.count(F.lit(1)).alias("found"), F.sum(F.col("_n") - 1).cast("long").alias("extra"))
    return sums.select(group, "found", "extra", (F.col("found") / total).alias("completeness"), (F.col("extra") / total).alias("contamination"))


def matrix_correlation(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """One row: the correlation of two matrices cell by cell, each melted to (row, column, value)."""
    long = lambda m, v: m.unpivot([row], [c for c in m.columns if c != row], "column", v)
    return long(a, "x").join(long(b, "y"), [row, "column"]).agg(F.count(F.lit(1)).alias("cells"), F.corr("x", "y").alias("r"))


def cross_contamination(depths: DataFrame, contig: str, library: str, depth: str, ratio: float) -> DataFrame:
    """Contigs whose own library has less than ``1 / ratio`` of another's depth: a grouped maximum, joined back."""
    best = depths.groupBy(contig).agg(F.max(F.struct(depth, library)).alias("_m"))
    return depths.join(best, contig).filter((F.col(library) != F.col(f"_m.{library}")) & (F.col(depth) * ratio < F.col(f"_m.{depth}"))).select(contig, library, depth, F.col(f"_m.{library}").alias("source"))
