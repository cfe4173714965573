"""Alignments and variants: filters by edits, alleles of reads, calls with depth from coverage, duplicates by place, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import alignments as A
from seqloom.operators import intervals as I


def edit_filter(rows: DataFrame, cigar: str = "cigar", md: str = "md", min_identity: float = 0.0, max_identity: float = 1.0, **most: int) -> DataFrame:
    """Alignments whose identity lies in a range and whose ``subs``, ``ins``, ``dels``, ``ins_events``, ``del_events`` and ``clipped`` aren't above what is given."""
    e = rows.withColumn("_e", A.edits(F.col(cigar), F.col(md)))
    keep = F.col("_e.identity").between(min_identity, max_identity)
    for name, value in most.items():
        keep &= F.col(f"_e.{name}") <= value
    return e.filter(keep).drop("_e")


def substitutions_only(rows: DataFrame, least: int = 1, most: int | None = None, cigar: str = "cigar", md: str = "md") -> DataFrame:
    """Alignments with substitutions, so many, and no insertion or deletion."""
    e = A.edits(F.col(cigar), F.col(md))
    kept = rows.withColumn("_e", e).filter((F.col("_e.subs") >= least) & (F.col("_e.ins") == 0) & (F.col("_e.dels") == 0))
    return (kept if most is None else kept.filter(F.col("_e.subs") <= most)).drop("_e")


def read_alleles(rows: DataFrame, name: str = "qname", scaf: str = "scaf") -> DataFrame:
    """``(name, scaf, pos, kind, ref, alt, plus, mapq)``: a row an allele a read shows."""
    own = A.alleles(F.col("cigar"), F.col("md"), F.col("pos"), F.col("bases"))
    plus = (F.col("flag").bitwiseAND(16) == 0).cast("int").alias("plus")
    return rows.select(name, scaf, plus, "mapq", F.explode(own).alias("a")).select(name, scaf, "a.pos", "a.kind", "a.ref", "a.alt", "plus", "mapq")


def variant_counts(alleles: DataFrame, scaf: str = "scaf") -> DataFrame:
    """``(scaf, pos, kind, ref, alt, n, plus, mapq_sum, mapq_max)``: alleles put together over reads."""
    return alleles.groupBy(scaf, "pos", "kind", "ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.sum("plus").alias("plus"), F.sum("mapq").alias("mapq_sum"), F.max("mapq").alias("mapq_max"))


def with_depth(variants: DataFrame, segments: DataFrame, scaf: str = "scaf", bin_size: int = 1024) -> DataFrame:
    """Adds ``depth`` and ``fraction`` of the coverage at each variant's place; a place without coverage has depth 0."""
    cover = segments.select(F.col(scaf).alias(scaf), "start", "stop", "depth")
    placed = I.within(variants, cover, scaf, "pos", bin_size, how="left").drop("start", "stop")
    return placed.withColumn("depth", F.greatest(F.coalesce("depth", F.lit(0)).cast("long"), F.col("n"))).withColumn("fraction", F.col("n") / F.col("depth"))


def variant_tiers(variants: DataFrame, min_reads: int = 2, min_fraction: float = 0.1, min_mapq_max: int = 20, min_mapq_mean: float = 10.0, min_strand: float = 0.1, min_score: float = 0.0) -> DataFrame:
    """Two tiers: cheap tests of counts and maxima first, then means and the score.

    Means are tested as ``n * least > sum``, without a division. ``score`` is the product of the read
    support, fraction, strand balance and mapping quality parts; ``phred`` is 2.5 times the Phred value of
    1 - 0.998 * score, 0 for score 0.
    """
    n = F.col("n")
    fast = (n >= min_reads) & (F.col("mapq_max") >= min_mapq_max) & (F.col("fraction") >= min_fraction)
    minor = F.least("plus", n - F.col("plus"))
    full = ~(n * min_mapq_mean > F.col("mapq_sum")) & ~(n * min_strand > minor)
    balance = (minor + 1) / (F.greatest("plus", n - F.col("plus")) + 1)
    score = (1 - F.pow(F.lit(0.5), n)) * F.sqrt(F.least("fraction", F.lit(1.0))) * F.sqrt(balance) * F.least(F.col("mapq_sum") / n / 60, F.lit(1.0))
    out = variants.filter(fast).filter(full).withColumn("score", score).filter(F.col("score") >= min_score)
    return out.withColumn("phred", F.when(F.col("score") > 0, -25 * F.log10(1 - 0.998 * F.col("score"))).otherwise(0.0))


def unsupported_filter(rows: DataFrame, alleles: DataFrame, supported: DataFrame, most: int, name: str = "qname") -> DataFrame:
    """Alignments with at most ``most`` alleles that ``supported`` doesn't hold."""
    keys = ["scaf", "pos", "kind", "ref", "alt"]
    bad = alleles.join(supported.select(*keys).distinct(), keys, "left_anti").groupBy(name).agg(F.count(F.lit(1)).alias("_bad")).filter(F.col("_bad") > most)
    return rows.join(bad.select(name), name, "left_anti")


def mapping_duplicates(rows: DataFrame, error: Column, order: str = "qname") -> DataFrame:
    """One alignment of each 5' place (start on plus, last symbol on minus), scaffold and strand: the one with the least error, then the first."""
    minus = F.col("flag").bitwiseAND(16) > 0
    five = F.when(minus, A.stop_of(F.col("cigar"), F.col("pos")) + A.trailing_clip(F.col("cigar")) - 1).otherwise(F.col("pos") - A.leading_clip(F.col("cigar")))
    keyed = rows.withColumns({"_five": five, "_minus": minus, "_error": error})
    best = keyed.groupBy("scaf", "_five", "_minus").agg(F.min(F.struct("_error", order)).alias("_best"))
    return keyed.join(best, ["scaf", "_five", "_minus"]).filter((F.col("_error") == F.col("_best._error")) & (F.col(order) == F.col(f"_best.{order}"))).drop("_five", "_minus", "_error", "_best")


def alignment_statistics(rows: DataFrame) -> DataFrame:
    """``(scaf, reads, reverse, duplicates, bases, clipped, subs, ins, dels, mean_identity, mean_mapq)``."""
    e = rows.withColumn("_e", A.edits(F.col("cigar"), F.col("md")))
    flag = lambda bit: F.sum((F.col("flag").bitwiseAND(bit) > 0).cast("long"))
    total = lambda c: F.sum(F.col(f"_e.{c}")).cast("long").alias(c)
    return e.groupBy("scaf").agg(F.count(F.lit(1)).alias("reads"), flag(16).alias("reverse"), flag(1024).alias("duplicates"), F.sum(F.length("bases")).cast("long").alias("bases"), total("clipped"), total("subs"), total("ins"), total("dels"), F.avg("_e.identity").alias("mean_identity"), F.avg("mapq").alias("mean_mapq"))


def graded(rows: DataFrame, truth: DataFrame, name: str = "qname", slack: int = 20) -> DataFrame:
    """One row: how alignments agree with true places: ``strict`` (same place), ``loose`` (within ``slack``), ``wrong``, ``unmapped`` and ``extra``."""
    a = rows.select(F.col(name).alias("_a"), F.col("scaf").alias("_s"), F.col("pos").alias("_p"), F.col("flag").bitwiseAND(16).alias("_f"))
    b = truth.select(F.col(name).alias("_b"), F.col("scaf").alias("_ts"), F.col("pos").alias("_tp"), F.col("flag").bitwiseAND(16).alias("_tf"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    same = (F.col("_s") == F.col("_ts")) & (F.col("_f") == F.col("_tf"))
    strict, loose = same & (F.col("_p") == F.col("_tp")), same & (F.abs(F.col("_p") - F.col("_tp")) <= slack)
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(count(strict).alias("strict"), count(loose).alias("loose"), count(met & ~loose).alias("wrong"), count(F.col("_a").isNull()).alias("unmapped"), count(F.col("_b").isNull()).alias("extra"))


def physical_spans(rows: DataFrame, pair: Column) -> DataFrame:
    """``(scaf, start, stop)``: from the first to behind the last symbol of both mates, of pairs on one scaffold."""
    spans = rows.select(pair.alias("_pair"), "scaf", "pos", A.stop_of(F.col("cigar"), F.col("pos")).alias("stop"))
    met = spans.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n"), F.min("scaf").alias("scaf"), F.max("scaf").alias("_other"), F.min("pos").alias("start"), F.max("stop").alias("stop"))
    return met.filter((F.col("_n") == 2) & (F.col("scaf") == F.col("_other"))).select("scaf", "start", "stop")


def binned_coverage(segments: DataFrame, key: str, width: int) -> DataFrame:
    """``(key, bin, bases, mean_depth, normalised)``: depth summed over bins, and over the key's mean; from segments, never a row a base."""
    cut = segments.select(key, "start", "stop", "depth", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("bin"))
    part = F.least("stop", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width)
    bins = cut.groupBy(key, "bin").agg(F.sum(part * F.col("depth")).cast("long").alias("bases")).withColumn("mean_depth", F.col("bases") / width)
    whole = bins.groupBy(key).agg(F.avg("mean_depth").alias("_mean"))
    return bins.join(whole, key).withColumn("normalised", F.when(F.col("_mean") > 0, F.col("mean_depth") / F.col("_mean"))).drop("_mean")


def interval_coverage(intervals: DataFrame, segments: DataFrame, key: str, name: str, width: int = 256) -> DataFrame:
    """``(name, bases, covered, fraction, mean_depth)`` of intervals (genes, transcripts): a range join by bins."""
    a = intervals.select(key, name, F.col("start").alias("a"), F.col("stop").alias("b")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    s = segments.filter("depth > 0").select(F.col(key).alias("_k"), "start", "stop", "depth", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("_b"))
    part = F.greatest(F.least("b", "stop", (F.col("_bin") + 1) * width) - F.greatest("a", "start", F.col("_bin") * width), F.lit(0))
    met = a.join(s, (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")), "left")
    sums = met.groupBy(name).agg(F.max(F.col("b") - F.col("a")).alias("length"), F.coalesce(F.sum(part * F.col("depth")), F.lit(0)).cast("long").alias("bases"), F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("covered"))
    return sums.select(name, "bases", "covered", (F.col("covered") / F.col("length")).alias("fraction"), (F.col("bases") / F.col("length")).alias("mean_depth"))


def dosage_merge(calls: DataFrame, keys: list[str], dosage: str, ploidy: int) -> DataFrame:
    """``(keys, dosage, genotype)``: alternate copies summed over calls, and the genotype with that many alternate alleles behind the reference ones."""
    sums = calls.groupBy(*keys).agg(F.least(F.sum(dosage), F.lit(ploidy)).cast("long").alias("dosage"))
    alleles = F.concat(F.array_repeat(F.lit("0"), (F.lit(ploidy) - F.col("dosage")).cast("int")), F.array_repeat(F.lit("1"), F.col("dosage").cast("int")))
    return sums.withColumn("genotype", F.array_join(alleles, "/"))
