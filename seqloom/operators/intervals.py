"""Interval algebra, coverage and order-dependent operators. Half-open intervals ``(scaf, start, stop)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def swept(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events ``(keys, at, ...)``, one row a place, sorted over range partitions: what ``run_up`` takes."""
    from seqloom.operators.graphs import cut

    return cut(events.repartitionByRange(*keys, "at").withColumn("_p", F.spark_partition_id()))


def run_up(placed: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds the sums up to each place, ``..._to``, and ``next``, the key's next place (null at its last).

    What opens in a key closes in it, so sums over all keys in order are the key's own, and neither a window nor a
    task has to hold a whole key: partial sums of range partitions, a row a partition, and each partition's first place.
    """
    order = [*keys, "at"]
    w, whole = W.partitionBy("_p").orderBy(*order), W.orderBy("_q")
    ends = placed.groupBy(F.col("_p").alias("_q")).agg(F.min(F.struct(*order)).alias("_first"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    ends = ends.select("_q", F.lead("_first").over(whole).alias("_after"), *[F.coalesce(F.sum(f"_s_{c}").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{c}") for c in sums])
    joined = placed.withColumn("_next", F.lead(F.struct(*order)).over(w)).join(F.broadcast(ends), F.col("_p") == F.col("_q"))  # a row a partition
    after = F.coalesce("_next", "_after")
    same = reduce(lambda x, y: x & y, [after[k] == F.col(k) for k in keys])
    run = [(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col(f"_b_{c}")).alias(f"{c}_to") for c in sums]
    return joined.select(*placed.columns, *run, F.when(same, after["at"]).alias("next"))


def merge(rows: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", gap: int = 0) -> DataFrame:
    """Gaps and islands: intervals that overlap or are at most ``gap`` apart become one; ``n`` is their number. Empty intervals take no part."""
    real = rows.filter(F.col(start) < F.col(stop))
    events = real.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d"), F.lit(1).alias("s")).union(real.select(*keys, F.col(stop) + gap, F.lit(-1), F.lit(0)))
    places = events.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum("s").alias("s")).filter("d <> 0 or s > 0")
    deep = run_up(swept(places, keys), keys, ["d"]).withColumn("open", ((F.col("d_to") > 0) & (F.col("d_to") == F.col("d"))).cast("int")).withColumnRenamed("next", "stop")
    runs = run_up(deep, keys, ["open"]).filter("d_to > 0")
    return runs.groupBy(*keys, "open_to").agg(F.min("at").alias(start), (F.max("stop") - gap).alias(stop), F.sum("s").alias("n")).drop("open_to")


def depth_segments(rows: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """``(keys, start, stop, depth)``: +1 and -1 events, summed by place first, then run up by range partitions. Never a row a base."""
    events = rows.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).union(rows.select(*keys, F.col(stop), F.lit(-1)))
    steps = events.groupBy(*keys, "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    return run_up(swept(steps, keys), keys, ["d"]).filter("next is not null").select(*keys, F.col("at").alias("start"), F.col("next").alias("stop"), F.col("d_to").alias("depth"))


def combine(sets: list[DataFrame], keys: list[str], mode: str) -> DataFrame:
    """Union, intersection of all, or the first without the others; abutting pieces are merged. The depth of each set is run up in one sweep over all."""
    names = [f"s{i}" for i in range(len(sets))]
    one = lambda i, v: [F.lit(v if j == i else 0).alias(n) for j, n in enumerate(names)]
    real = [s.filter("start < stop") for s in sets]
    events = reduce(DataFrame.union, [m.select(*keys, F.col("start").alias("at"), *one(i, 1)).union(m.select(*keys, F.col("stop"), *one(i, -1))) for i, m in enumerate(real)])
    steps = events.groupBy(*keys, "at").agg(*[F.sum(n).alias(n) for n in names])
    pieces = run_up(swept(steps, keys), keys, names).filter("next is not null")
    inside = sum(((F.col(f"{n}_to") > 0).cast("int") for n in names), F.lit(0))
    keep = {"union": inside > 0, "intersect": inside == len(sets), "subtract": (F.col("s0_to") > 0) & (inside == 1)}[mode]
    return merge(pieces.filter(keep).select(*keys, F.col("at").alias("start"), F.col("next").alias("stop")), keys).select(*keys, "start", "stop")


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, bin_size: int, start: str = "start", stop: str = "stop", how: str = "inner") -> DataFrame:
    """Range join as an equi-join on (key, bin): an interval meets the bins it covers, a point its one bin."""
    placed = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(stop).alias("_e"), *[c for c in intervals.columns if c not in (key,)], F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(stop) - 1) / bin_size))).alias("_bin"))
    hit = (F.col(key) == F.col("_k")) & (F.floor(F.col(at) / bin_size) == F.col("_bin")) & (F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e"))
    out = points.join(placed, hit, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_k", "_s", "_e", "_bin")


def coverage_stats(segments: DataFrame, lengths: DataFrame, key: str, length: str) -> DataFrame:
    """``(key, length, avg_fold, covered_bases, covered_percent, max_depth)`` from depth segments."""
    sums = segments.filter("depth > 0").groupBy(key).agg(F.sum((F.col("stop") - F.col("start")) * F.col("depth")).alias("bases"), F.sum(F.col("stop") - F.col("start")).alias("covered_bases"), F.max("depth").alias("max_depth"))
    zero = F.lit(0).cast("long")
    joined = lengths.join(sums, key, "left").withColumns({c: F.coalesce(c, zero) for c in ("bases", "covered_bases", "max_depth")})
    return joined.select(key, length, (F.col("bases") / F.col(length)).alias("avg_fold"), "covered_bases", (100.0 * F.col("covered_bases") / F.col(length)).alias("covered_percent"), "max_depth")


def depth_histogram(segments: DataFrame, lengths: DataFrame, key: str, length: str) -> DataFrame:
    """``(depth, bases)``, depth 0 included."""
    seen = segments.filter("depth > 0").groupBy("depth").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))
    covered = segments.filter("depth > 0").agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("c"))
    zero = lengths.agg(F.sum(length).alias("l")).crossJoin(covered).select(F.lit(0).cast("long").alias("depth"), (F.col("l") - F.col("c")).cast("long").alias("bases"))  # one row by one row
    return seen.select(F.col("depth").cast("long").alias("depth"), F.col("bases").cast("long").alias("bases")).union(zero)


def nearby(rows: DataFrame, keys: list[str], at: str, distance: int, out: str = "near") -> DataFrame:
    """Number of other rows within ``distance``."""
    w = W.partitionBy(*keys).orderBy(at).rangeBetween(-distance, distance)
    return rows.withColumn(out, F.count(F.lit(1)).over(w) - 1)


def low_windows(rows: DataFrame, keys: list[str], order: str, value: str, window: int, under: float) -> DataFrame:
    """Rows in which the mean of the last ``window`` values is under a threshold; whole windows only."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).filter((F.col("_n") == window) & (F.col("mean") < under)).drop("_n")


def sessions(rows: DataFrame, key: str, at: Column, gap: float) -> DataFrame:
    """Runs of rows no more than ``gap`` apart."""
    w = W.partitionBy(key).orderBy("_at")
    marked = rows.withColumn("_at", at).withColumn("_new", F.when(F.col("_at") - F.lag("_at").over(w) <= gap, 0).otherwise(1))
    return marked.withColumn("session", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("_at", "_new")


def smooth(histogram: DataFrame, x: str, y: str, radius: int) -> DataFrame:
    """Triangle filter: each row's neighbours on x up to ``radius``, weights falling linearly; a self-join of a histogram, by offset."""
    weights = [(o, radius + 1 - abs(o)) for o in range(-radius, radius + 1)]
    shifted = histogram.select(F.explode(F.array(*[F.struct((F.col(x) + o).alias("x"), F.lit(w).alias("w")) for o, w in weights])).alias("s"), F.col(y).alias("y")).groupBy(F.col("s.x").alias(x)).agg(F.sum(F.col("y") * F.col("s.w")).alias("_sum"))
    return histogram.join(shifted, x).select(x, y, (F.col("_sum") / sum(w for _, w in weights)).alias("smooth"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row at or before it: one sort of both, no range join."""
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_v")
