"""Row filters, edits and routes: no shuffles but where pairs are judged together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def filter_chain(reads: DataFrame, *, min_length: int = 0, max_length: int | None = None, min_gc: float = 0.0, max_gc: float = 1.0, max_ns: int | None = None, min_run: int = 0, min_quality: float | None = None, min_base_frequency: float = 0.0, bases: str = "bases", quals: str | None = None) -> DataFrame:
    """The ordered read filters in one projection and one filter; Catalyst joins the conditions."""
    b = F.col(bases)
    keep = F.length(b) >= min_length
    if max_length is not None:
        keep &= F.length(b) <= max_length
    if min_gc > 0 or max_gc < 1:
        keep &= S.gc(b).between(min_gc, max_gc)
    if max_ns is not None:
        keep &= S.count_of(b, "Nn") <= max_ns
    if min_run:
        keep &= F.coalesce(S.longest_defined_run(b), F.lit(0)) >= min_run
    if min_base_frequency:
        keep &= F.least(*[S.count_of(b, x) for x in "ACGT"]) >= min_base_frequency * F.length(b)
    if min_quality is not None and quals:
        keep &= F.coalesce(S.average_quality(F.col(quals)) >= min_quality, F.lit(False))
    return reads.filter(keep)


def keep_pairs(reads: DataFrame, pair: str, good: Column, require_both: bool = False) -> DataFrame:
    """Pairs stay if one mate is good, or with ``require_both`` if all are."""
    flags = F.min(good.cast("int")) if require_both else F.max(good.cast("int"))
    kept = reads.groupBy(pair).agg(flags.alias("_ok")).filter("_ok = 1").select(pair)
    return reads.join(kept, pair, "left_semi")


def quality_trim(reads: DataFrame, mode: str, threshold: float, bases: str = "bases", quals: str = "quals", window: int = 4) -> DataFrame:
    """Cuts bases and qualities: ``optimal``, ``left``, ``right``, ``both`` or ``window``."""
    q, b = F.col(quals), F.col(bases)
    if mode == "optimal":
        cut = S.optimal_range(q, 10 ** (-threshold / 10))
        start, length = cut["start"], cut["stop"] - cut["start"]
    elif mode == "window":
        start, length = F.lit(0), S.window_trim_right(q, window, int(threshold))
    else:
        left = S.left_trim_run(q, int(threshold)) if mode in ("left", "both") else F.lit(0)
        right = S.right_trim_run(q, int(threshold)) if mode in ("right", "both") else F.lit(0)
        start, length = left, F.greatest(F.size(q) - left - right, F.lit(0))
    cut = reads.withColumn("_cut", F.struct(start.alias("start"), length.alias("length")))
    s, n = F.col("_cut.start"), F.col("_cut.length")
    return cut.withColumns({bases: F.substring(b, s + 1, n), quals: F.slice(q, s + 1, n)}).drop("_cut")


def n_trim(bases: Column) -> Column:
    return F.regexp_replace(bases, "^[Nn]+|[Nn]+$", "")


def break_long(reads: DataFrame, length: int, bases: str = "bases") -> DataFrame:
    """Rows cut to pieces of at most ``length``, with ``piece`` from 0."""
    b = F.col(bases)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(b) / length) - 1, F.lit(0)).cast("int"))
    return reads.select("*", F.explode(starts).alias("piece")).withColumn(bases, F.substring(b, F.col("piece") * length + 1, F.lit(length)))


def shred(reads: DataFrame, length: int, step: int, bases: str = "bases") -> DataFrame:
    """Overlapping windows, the last one shorter where the end falls into it."""
    b = F.col(bases)
    last = F.greatest(F.length(b) - length + step - 1, F.lit(0))
    return reads.select("*", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start")).filter((F.col("start") == 0) | (F.col("start") < F.length(b))).withColumn(bases, F.substring(b, F.col("start") + 1, F.lit(length)))


def shrink_homopolymers(bases: Column, most: int = 1) -> Column:
    return F.regexp_replace(bases, rf"(.)\1{{{most - 1},}}", "$1" * most)


def quantise(quals: Column, levels: tuple[int, ...]) -> Column:
    """Each quality to the nearest level, the lower of two."""
    def nearest(q: Column) -> Column:
        return F.array_min(F.array(*[F.struct(F.abs(q - x).alias("d"), F.lit(x).alias("x")) for x in levels]))["x"]

    return F.transform(quals, nearest)


def mask(bases: Column, start: Column, stop: Column, symbol: str = "N") -> Column:
    """Symbols from start up to stop, exclusive, replaced."""
    n = F.greatest(stop - start, F.lit(0))
    return F.concat(F.substring(bases, F.lit(1), start), F.repeat(F.lit(symbol), n), F.substring(bases, stop + 1, F.length(bases)))


def name_filter(rows: DataFrame, names: DataFrame, name: str, include: bool = True, mode: str = "exact", ignore_case: bool = False) -> DataFrame:
    """Rows whose name is in (``exact``), starts with (``prefix``) or holds (``contains``) one of ``names(name)``; rows stay as often as they are.

    All are equi-joins over distinct names: a prefix meets as many keys as there are lengths of names; a
    part meets where a run of symbols as long as the shortest name is shared, and is then looked for in full.
    """
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    wanted = names.select(fold(F.col("name")).alias("_n")).filter("_n is not null").distinct()
    key = fold(F.col(name))
    if mode != "exact":
        keys = rows.select(key.alias("_key")).filter("_key is not null").distinct()
        lengths = sorted(r[0] for r in wanted.select(F.length("_n")).distinct().collect())  # as many as names have lengths
        if mode == "prefix":
            tries = keys.select("_key", F.explode(F.array(*[F.substring("_key", 1, x) for x in lengths]) if lengths else F.array().cast("array<string>")).alias("_try"))
            met = tries.join(wanted, F.col("_try") == F.col("_n"))
        else:
            q = lengths[0] if lengths else 1
            places = F.sequence(F.lit(1), F.greatest(F.length("_key") - q + 1, F.lit(1)))
            tries = keys.select("_key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("_key", i, F.lit(q))))).alias("_try"))
            met = tries.join(wanted, (F.substring("_n", 1, q) == F.col("_try")) & F.col("_key").contains(F.col("_n")))
        wanted = met.select(F.col("_key").alias("_n")).distinct()
    return rows.join(wanted, key == F.col("_n"), "left_semi" if include else "left_anti")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Numbers from 0 in order: a range-partitioned sort, cut by a checkpoint, and each partition's place plus its first number. No task holds all rows."""
    from seqloom.operators.graphs import cut

    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    done = cut(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), inside.alias("_i")))
    starts = done.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(F.col("_p").alias("_q"), before.alias("_first"))
    return done.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(out, F.col("_first") + F.col("_i")).drop("_p", "_q", "_i", "_first")  # a row a partition


def rename(rows: DataFrame, prefix: str, order: list[Column], name: str = "id") -> DataFrame:
    """Names ``prefix_number`` in order, from 0."""
    return numbered(rows, order, "_number").withColumn(name, F.concat(F.lit(prefix + "_"), F.col("_number").cast("string"))).drop("_number")


def unique_names(rows: DataFrame, name: str, order: Column) -> DataFrame:
    """Repeated names get ``_2``, ``_3`` and so on."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return rows.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def flags_filter(rows: DataFrame, flag: str = "flag", required: int = 0, forbidden: int = 0) -> DataFrame:
    f = F.col(flag)
    return rows.filter((f.bitwiseAND(required) == required) & (f.bitwiseAND(forbidden) == 0))


def route(rows: DataFrame, routes: dict[str, Column], other: str = "other") -> DataFrame:
    """A ``route`` column: the first condition that holds. A sink writes it with ``partitionBy("route")`` in one pass."""
    out = F.lit(other)
    for name, condition in reversed(routes.items()):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return rows.withColumn("route", out)
