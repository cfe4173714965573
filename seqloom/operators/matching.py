"""What k-mer matches do to reads: trims, masks, splits, thresholds, tips shorter than k, and neighbourhoods of either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import kmers as K
from seqloom.operators import packed as P


def index(refs: DataFrame, id_column: str, bases: str, k: int, distance: int = 0, edits: bool = False) -> DataFrame:
    """``(key, ref_id)`` of packed reference k-mers and, with ``distance`` 1, their neighbours; a k-mer belongs to the least reference that has it.

    ``edits`` adds deletions (the next reference symbol moves up) and insertions to substitutions.
    """
    if not distance:
        return P.placed(refs, id_column, bases, k).groupBy("key").agg(F.min(id_column).alias("ref_id"))
    runs = F.explode(F.split(bases, "[^ACGT]+"))
    own = refs.select(F.col(id_column).alias("ref_id"), runs.alias("_run")).filter(F.length("_run") >= k)
    places = S.let(F.col("_run"), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - k + 1), lambda i: F.struct(F.substring(r, i, F.lit(k)).alias("kmer"), F.substring(r, i + k, F.lit(1)).alias("after"))))
    one = own.select("ref_id", F.explode(places).alias("x")).groupBy("x.kmer", "x.after").agg(F.min("ref_id").alias("ref_id"))
    around = edit_neighbours(F.col("kmer"), F.col("after"), k) if edits else K.mutants(F.col("kmer"))
    return one.select("ref_id", F.explode(around).alias("kmer")).groupBy(S.packed_kmer(F.col("kmer")).alias("key")).agg(F.min("ref_id").alias("ref_id"))


def edit_neighbours(kmer: Column, after: Column, k: int, alphabet: str = "ACGT") -> Column:
    """The k-mer and everything one substitution, deletion or insertion away, k symbols long; a deletion takes the symbol after, if there is one."""
    places = F.sequence(F.lit(1), F.lit(k))
    dropped = F.when(F.length(after) == 1, F.transform(places, lambda i: F.concat(F.substring(kmer, F.lit(1), i - 1), F.substring(kmer, i + 1, F.lit(k)), after))).otherwise(F.array().cast("array<string>"))
    added = F.flatten(F.transform(places, lambda i: F.transform(F.array(*[F.lit(a) for a in alphabet]), lambda a: F.concat(F.substring(kmer, F.lit(1), i - 1), a, F.substring(kmer, i, k - i)))))
    return F.array_distinct(F.concat(K.mutants(kmer, alphabet), dropped, added))


def found(reads: DataFrame, id_column: str, bases: str, k: int, refs: DataFrame) -> DataFrame:
    """``(id, pos, ref_id)`` of a read's k-mers that ``refs(key, ref_id)`` has."""
    return P.placed(reads, id_column, bases, k).join(refs, "key").select(id_column, "pos", "ref_id")


def found_near(reads: DataFrame, id_column: str, bases: str, k: int, refs: DataFrame) -> DataFrame:
    """As ``found``, with substitutions put into the reads' k-mers instead of the references': each distinct k-mer once, whatever the reads that hold it."""
    own = P.placed(reads, id_column, bases, k)
    distinct = own.select("key").distinct().select("key", F.explode(K.mutants(S.unpacked_kmer(F.col("key"), k))).alias("m"))
    near = distinct.select("key", S.packed_kmer(F.col("m")).alias("near")).join(refs.withColumnRenamed("key", "near"), "near").groupBy("key").agg(F.min("ref_id").alias("ref_id"))
    return own.join(near, "key").select(id_column, "pos", "ref_id")


def trim(reads: DataFrame, hits: DataFrame, id_column: str, bases: str, k: int, side: str = "right") -> DataFrame:
    """Reads cut at their matches: ``right`` keeps what stands before the first, ``left`` what stands behind the last."""
    ends = hits.groupBy(id_column).agg(F.min("pos").alias("_first"), (F.max("pos") + k).alias("_last"))
    joined = reads.join(ends, id_column, "left")
    kept = F.substring(bases, F.lit(1), F.coalesce("_first", F.length(bases))) if side == "right" else F.substring(F.col(bases), F.coalesce("_last", F.lit(0)) + 1, F.length(bases))
    return joined.withColumn(bases, kept).drop("_first", "_last")


def spans_of(positions: Column, k: int) -> Column:
    """``array<struct<start, stop>>``: overlapping and touching k-mers put together, from sorted positions."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(s: Column, p: Column) -> Column:
        last = F.element_at(s, -1)
        grown = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last["start"].alias("start"), (p + k).alias("stop"))))
        return F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["stop"] >= p), grown).otherwise(F.concat(s, F.array(F.struct(p.alias("start"), (p + k).alias("stop")))))

    return F.aggregate(positions, none, step)


def _with_spans(reads: DataFrame, hits: DataFrame, id_column: str, k: int) -> DataFrame:
    places = hits.groupBy(id_column).agg(F.array_sort(F.collect_set("pos")).alias("_places"))  # a read's own
    none = F.array().cast("array<int>")
    return reads.join(places, id_column, "left").withColumn("_spans", spans_of(F.coalesce("_places", none), k)).drop("_places")


def mask(reads: DataFrame, hits: DataFrame, id_column: str, bases: str, k: int, symbol: str = "N") -> DataFrame:
    """Every matched symbol replaced."""
    put = F.aggregate("_spans", F.col(bases), lambda s, x: F.overlay(s, F.repeat(F.lit(symbol), x["stop"] - x["start"]), x["start"] + 1, x["stop"] - x["start"]))
    return _with_spans(reads, hits, id_column, k).withColumn(bases, put).drop("_spans")


def split(reads: DataFrame, hits: DataFrame, id_column: str, bases: str, k: int, least: int = 1) -> DataFrame:
    """A row a piece between matches, ``piece`` from 0, of at least ``least`` symbols."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))), F.col("_spans"), F.array(F.struct(F.length(bases).alias("start"), F.length(bases).alias("stop"))))
    numbers = F.sequence(F.lit(1), F.size("_spans") + 1)
    made = _with_spans(reads, hits, id_column, k).withColumn("_edges", edges)
    pieces = F.filter(F.transform(numbers, lambda i: F.substring(F.col(bases), F.get("_edges", i - 1)["stop"] + 1, F.get("_edges", i)["start"] - F.get("_edges", i - 1)["stop"])), lambda x: F.length(x) >= least)
    return made.select(*[c for c in reads.columns if c != bases], F.posexplode(pieces).alias("piece", bases))


def tip_matches(reads: DataFrame, refs: DataFrame, id_column: str, bases: str, k: int, mink: int, ref_bases: str = "bases") -> DataFrame:
    """``(id, tip)``: the longest end of a read, of ``mink`` to ``k - 1`` symbols, that a reference begins with."""
    lengths = F.array(*[F.lit(x) for x in range(mink, k)])
    short = refs.select(F.explode(F.transform(lengths, lambda n: F.substring(F.col(ref_bases), F.lit(1), n))).alias("part")).filter(F.length("part") >= mink).distinct()
    ends = reads.select(id_column, F.explode(F.transform(lengths, lambda n: F.when(F.length(bases) >= n, F.right(F.col(bases), n)))).alias("part")).filter("part is not null")
    return ends.join(short, "part").groupBy(id_column).agg(F.max(F.length("part")).alias("tip"))


def trim_tips(reads: DataFrame, tips: DataFrame, id_column: str, bases: str) -> DataFrame:
    cut = F.length(bases) - F.coalesce("tip", F.lit(0))
    return reads.join(tips, id_column, "left").withColumn(bases, F.substring(F.col(bases), F.lit(1), cut)).drop("tip")


def thresholds(reads: DataFrame, hits: DataFrame, id_column: str, bases: str, k: int, min_hits: int = 1, min_fraction: float = 0.0, min_covered: float = 0.0) -> DataFrame:
    """``(id, hits, fraction, covered)`` of reads with enough matches: in number, of their k-mers, of their symbols."""
    sums = hits.groupBy(id_column).agg(F.countDistinct("pos").alias("hits"))
    covered = K.covered_bases(hits, id_column, k)
    total = reads.select(id_column, F.length(bases).alias("_n"))
    joined = total.join(sums, id_column).join(covered, id_column)
    joined = joined.select(id_column, "hits", (F.col("hits") / (F.col("_n") - k + 1)).alias("fraction"), (F.col("covered") / F.col("_n")).alias("covered"))
    return joined.filter((F.col("hits") >= min_hits) & (F.col("fraction") >= min_fraction) & (F.col("covered") >= min_covered))


def by_sequence(reads: DataFrame, others: DataFrame, bases: str, include: bool = True) -> DataFrame:
    """Reads whose whole sequence, on either strand, is (or isn't) one of the others'; compared by hashes first, then in full."""
    own = S.canonical(F.col(bases))
    wanted = others.select(S.canonical(F.col(bases)).alias("_other")).distinct()
    return reads.join(wanted, (F.xxhash64(own) == F.xxhash64("_other")) & (own == F.col("_other")), "left_semi" if include else "left_anti")
