"""Statistics of reads, assemblies, alignments and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def base_composition(reads: DataFrame, bases: str = "bases") -> DataFrame:
    """One row: how often each symbol occurs."""
    return reads.agg(*[F.sum(S.count_of(F.col(bases), b)).cast("long").alias(b) for b in "ACGTN"], F.count(F.lit(1)).alias("reads"), F.sum(F.length(bases)).cast("long").alias("bases"))


def by_position(reads: DataFrame, bases: str = "bases", most: int | None = None) -> DataFrame:
    """``(pos, base, n)``, from 0."""
    b = F.col(bases) if most is None else F.substring(F.col(bases), F.lit(1), F.lit(most))
    return reads.select(F.posexplode(F.split(b, "")).alias("pos", "base")).filter("base <> ''").groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))


def binned(rows: DataFrame, value: Column, width: float) -> DataFrame:
    """``(bin, n)``."""
    return rows.groupBy(F.floor(value / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(histogram: DataFrame, x: str, n: str) -> DataFrame:
    """Running sums in order of x and their share; the histogram is small beside its rows."""
    w = W.orderBy(x).rowsBetween(W.unboundedPreceding, W.currentRow)
    return histogram.withColumn("cum", F.sum(n).over(w)).withColumn("share", F.col("cum") / F.sum(n).over(W.partitionBy()))


def nx_lx(rows: DataFrame, length: str, percents: tuple[int, ...] = (50, 90)) -> DataFrame:
    """``(percent, n, l)``: at the falling cumulative length's share, the length and the number of sequences.

    Lengths are counted first, so the one ordered window is over distinct lengths.
    """
    hist = rows.groupBy(F.col(length).alias("len")).agg(F.count(F.lit(1)).alias("k"))
    w = W.orderBy(F.col("len").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = hist.withColumn("cum", F.sum(F.col("len") * F.col("k")).over(w)).withColumn("before", F.sum("k").over(w) - F.col("k")).withColumn("total", F.sum(F.col("len") * F.col("k")).over(W.partitionBy()))
    out = run.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")).filter(F.col("cum") * 100 >= F.col("total") * F.col("percent"))
    first = out.groupBy("percent").agg(F.max(F.struct("len", "cum", "before", "k", "total")).alias("m"))
    need = F.ceil((F.col("m.total") * F.col("percent") / 100 - (F.col("m.cum") - F.col("m.len") * F.col("m.k"))) / F.col("m.len"))
    return first.select("percent", F.col("m.len").alias("n"), (F.col("m.before") + F.greatest(need, F.lit(1))).cast("long").alias("l"))


def duplicates(rows: DataFrame, key: Column, most: int, order: Column) -> DataFrame:
    """Adds ``copy`` (from 1 by order) and ``duplicate``: beyond ``most`` of one key."""
    w = W.partitionBy("_key").orderBy(order)
    return rows.withColumn("_key", key).withColumn("copy", F.row_number().over(w)).withColumn("duplicate", F.col("copy") > most).drop("_key")


def best_copy(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def quality_accuracy(observed: DataFrame, q: str, wrong: Column) -> DataFrame:
    """``(q, total, wrong, observed_q)``: what the error rate of each claimed quality comes to."""
    sums = observed.groupBy(q).agg(F.count(F.lit(1)).alias("total"), F.sum(wrong.cast("long")).alias("wrong"))
    return sums.withColumn("observed_q", F.when(F.col("wrong") > 0, -10 * F.log10(F.col("wrong") / F.col("total"))))


def rpkm(rows: DataFrame, key: str, length: str) -> DataFrame:
    """``(key, reads, rpkm)``: reads by thousand symbols of the reference and million reads."""
    sums = rows.groupBy(key).agg(F.count(F.lit(1)).alias("reads"), F.max(length).alias("len"))
    return sums.withColumn("total", F.sum("reads").over(W.partitionBy())).select(key, "reads", (F.col("reads") * 1e9 / (F.col("len") * F.col("total"))).alias("rpkm"))


def concordance(called: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives and false negatives by key."""
    a, b = called.select(*keys).distinct().withColumn("_a", F.lit(1)), truth.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("_b").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_a").isNull(), 1)).alias("fn"))


def score_sweep(scored: DataFrame, score: str, truth: Column) -> DataFrame:
    """``(score, tp, fp)``: both counts at or above each score. Scores are counted first."""
    sums = scored.groupBy(score).agg(F.sum(truth.cast("long")).alias("t"), F.sum((~truth).cast("long")).alias("f"))
    w = W.orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return sums.select(score, F.sum("t").over(w).alias("tp"), F.sum("f").over(w).alias("fp"))


def equal_mass(rows: DataFrame, value: str, weight: str, parts: int) -> DataFrame:
    """``(part, from_value, to_value, mass)``: runs of values in order with about equal weight; over distinct values."""
    hist = rows.groupBy(value).agg(F.sum(weight).alias("m"))
    w = W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = hist.withColumn("part", F.least(F.floor((F.sum("m").over(w) - F.col("m")) * parts / F.sum("m").over(W.partitionBy())), F.lit(parts - 1)).cast("int"))
    return placed.groupBy("part").agg(F.min(value).alias("from_value"), F.max(value).alias("to_value"), F.sum("m").alias("mass"))


def rollup_tree(facts: DataFrame, key: str, value: str, closure: DataFrame) -> DataFrame:
    """``(ancestor, total)``: sums of a node's subtree by the closure ``(node, ancestor)``; facts are summed by node before the join."""
    sums = facts.groupBy(F.col(key).alias("node")).agg(F.sum(value).alias("v"))
    return sums.join(closure, "node").groupBy("ancestor").agg(F.sum("v").alias("total"))


def peaks(histogram: DataFrame, x: str, y: str, least: int) -> DataFrame:
    """Places of a histogram above both neighbours (the first of a flat top) and at least ``least`` high."""
    changes = histogram.withColumn("_before", F.lag(y).over(W.orderBy(x))).filter(F.col("_before").isNull() | (F.col("_before") != F.col(y)))
    w = W.orderBy(x)
    return changes.withColumn("_l", F.coalesce(F.lag(y).over(w), F.lit(-1))).withColumn("_r", F.coalesce(F.lead(y).over(w), F.lit(-1))).filter((F.col(y) > F.col("_l")) & (F.col(y) > F.col("_r")) & (F.col(y) >= least)).select(x, y)
