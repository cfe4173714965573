"""Joins and aggregates over k-mers (any runs of k symbols, or words)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators.graphs import cut


def exploded(rows: DataFrame, id_column: str, kmers: Column, out: str = "kmer") -> DataFrame:
    """``(id, pos, kmer)``, pos from 0."""
    return rows.select(id_column, F.posexplode(kmers).alias("pos", out))


def counts(rows: DataFrame, kmers: Column, least: int = 1) -> DataFrame:
    """``(kmer, n)``: partial sums before the shuffle; ``least`` drops rare ones after it."""
    out = rows.select(F.explode(kmers).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least) if least > 1 else out


def histogram(counted: DataFrame, n: str = "n") -> DataFrame:
    """``(depth, unique_kmers, raw_kmers)``."""
    return counted.groupBy(F.col(n).alias("depth")).agg(F.count(F.lit(1)).alias("unique_kmers"), F.sum(n).cast("long").alias("raw_kmers"))


def two_depths(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(depth_a, depth_b, kmers)`` of k-mers in both."""
    return a.select("kmer", F.col("n").alias("depth_a")).join(b.select("kmer", F.col("n").alias("depth_b")), "kmer").groupBy("depth_a", "depth_b").agg(F.count(F.lit(1)).alias("kmers"))


def reference_index(refs: DataFrame, id_column: str, kmers: Column) -> DataFrame:
    """``(kmer, ref_id)``: a k-mer belongs to the first reference that has it."""
    return refs.select(F.col(id_column).alias("ref_id"), F.explode(kmers).alias("kmer")).groupBy("kmer").agg(F.min("ref_id").alias("ref_id"))


def mutants(kmer: Column, alphabet: str = "ACGT") -> Column:
    """The k-mer and everything one substitution away."""
    places = F.sequence(F.lit(1), F.length(kmer))
    changed = F.flatten(F.transform(places, lambda i: F.transform(F.array(*[F.lit(a) for a in alphabet]), lambda a: F.concat(F.substring(kmer, F.lit(1), i - 1), a, F.substring(kmer, i + 1, F.length(kmer))))))
    return F.array_distinct(F.concat(F.array(kmer), changed))


def hits(reads: DataFrame, id_column: str, kmers: Column, index: DataFrame) -> DataFrame:
    """``(id, pos, kmer, ref_id)`` of k-mers that the index has. Spark broadcasts the index if its size allows; else both sides shuffle by k-mer."""
    return exploded(reads, id_column, kmers).join(index, "kmer").select(id_column, "pos", "kmer", "ref_id")


def matched_reads(reads: DataFrame, id_column: str, kmers: Column, index: DataFrame, least: int = 1) -> DataFrame:
    """``(id, hits)`` of reads with at least ``least`` k-mers in the index."""
    return hits(reads, id_column, kmers, index).groupBy(id_column).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= least)


def best_reference(found: DataFrame, id_column: str, ambiguous: str = "first") -> DataFrame:
    """``(id, ref_id, hits)``: the reference with most hits; ties ``first`` (least id), ``toss`` or ``all``."""
    scored = found.groupBy(id_column, "ref_id").agg(F.count(F.lit(1)).alias("hits"))
    by = W.partitionBy(id_column).orderBy(F.col("hits").desc())
    if ambiguous == "first":
        return scored.groupBy(id_column).agg(F.max(F.struct("hits", (-F.col("ref_id")).alias("r"))).alias("m")).select(id_column, (-F.col("m.r")).alias("ref_id"), F.col("m.hits").alias("hits"))
    best = scored.withColumn("_rank", F.rank().over(by)).filter("_rank = 1").drop("_rank")
    if ambiguous == "all":
        return best
    return best.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(id_column))).filter("_n = 1").drop("_n")


def matched_span(found: DataFrame, id_column: str, k: int) -> DataFrame:
    """``(id, start, stop)``: from the first matched symbol to behind the last."""
    return found.groupBy(id_column).agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("stop"))


def covered_bases(found: DataFrame, id_column: str, k: int) -> DataFrame:
    """``(id, covered)``: symbols in at least one matched k-mer, from the gaps between starts."""
    after = F.lead("pos").over(W.partitionBy(id_column).orderBy("pos"))
    return found.select(id_column, "pos").distinct().withColumn("_next", after).groupBy(id_column).agg(F.sum(F.least(F.lit(k), F.coalesce(F.col("_next") - F.col("pos"), F.lit(k)))).cast("long").alias("covered"))


def first_seen(rows: DataFrame, order: str, kmers: Column) -> DataFrame:
    """``(kmer, first)``: the least order value that has it; the uniqueness curve is its histogram."""
    return rows.select(order, F.explode(kmers).alias("kmer")).groupBy("kmer").agg(F.min(order).alias("first"))


def read_depth(reads: DataFrame, id_column: str, kmers: Column, counted: DataFrame) -> DataFrame:
    """``(id, depth)``: the lower median of a read's k-mer counts."""
    joined = exploded(reads, id_column, kmers).join(counted, "kmer")
    return joined.groupBy(id_column).agg(F.sort_array(F.collect_list("n")).alias("_all")).select(id_column, F.element_at("_all", F.floor((F.size("_all") + 1) / 2).cast("int")).alias("depth"))


def normalise(reads: DataFrame, id_column: str, depth: DataFrame, target: int, least: int, draw: Column) -> DataFrame:
    """Reads of depth at least ``least`` stay with probability target over depth."""
    return reads.join(depth, id_column).filter((F.col("depth") >= least) & (draw < F.lit(float(target)) / F.col("depth")))


def sketch(rows: DataFrame, group: str, kmers: Column, size: int) -> DataFrame:
    """``(group, key, n, rank)``: the ``size`` least hashes of a group, with counts; hashes are the first 60 bits of MD5, the same on every engine."""
    keyed = rows.select(group, F.explode(kmers).alias("kmer")).groupBy(group, "kmer").agg(F.count(F.lit(1)).alias("n")).withColumn("key", hash60(F.col("kmer")))
    return bottom(keyed.select(group, "key", "n"), group, size)


def hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bottom(keyed: DataFrame, group: str, size: int) -> DataFrame:
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("key"))).filter(F.col("rank") <= size)


def compare_sketches(a: DataFrame, b: DataFrame, group: str, size: int) -> DataFrame:
    """``(q, r, hits, wkid)``: shared keys and their share of the smaller sketch; an inverted index, only pairs that share a key."""
    sizes = lambda s, name: s.groupBy(F.col(group).alias(name)).agg(F.count(F.lit(1)).alias(f"size_{name}"))
    shared = a.select(F.col(group).alias("q"), "key").join(b.select(F.col(group).alias("r"), "key"), "key").groupBy("q", "r").agg(F.count(F.lit(1)).alias("hits"))
    return shared.join(sizes(a, "q"), "q").join(sizes(b, "r"), "r").withColumn("wkid", F.col("hits") / F.least("size_q", "size_r")).select("q", "r", "hits", "wkid")


def widespread(rows: DataFrame, group: str, kmers: Column, least: int, hashes: Column | None = None) -> DataFrame:
    """``(kmer, groups)`` of k-mers in at least ``least`` groups: counted by 64-bit ``hashes`` (in the order of ``kmers``) in one shuffle, with a row that holds each; the k-mers themselves are read from those rows."""
    made = F.transform(kmers, lambda x: F.xxhash64(x)) if hashes is None else hashes
    own = rows.select("*", S.once(made).alias("_h"))
    placed = own.select(group, F.xxhash64("_h").alias("_row"), F.explode(F.array_distinct("_h")).alias("_key"))
    often = placed.repartition("_key").groupBy("_key", group).agg(F.min("_row").alias("_row")).groupBy("_key").agg(F.count(group).alias("groups"), F.min("_row").alias("_row")).filter(F.col("groups") >= least)
    often = cut(often)
    texts = own.withColumn("_row", F.xxhash64("_h")).join(often.select("_row").distinct(), "_row", "left_semi").select("_row", F.explode(F.arrays_zip(F.col("_h").alias("h"), kmers.alias("k"))).alias("_z"))
    named = texts.select("_row", F.col("_z.h").alias("_key"), F.col("_z.k").alias("kmer")).join(often, ["_row", "_key"])
    return named.groupBy("_key").agg(F.first("kmer").alias("kmer"), F.first("groups").alias("groups")).select("kmer", "groups")


def pivot_kmer(kmers: Column) -> Column:
    """The k-mer with the least hash: reads that share it are put together."""
    return F.array_min(F.transform(kmers, lambda x: F.struct(F.md5(x).alias("h"), x.alias("k"))))["k"]
