"""Set operations by explicit keys, ordering, sampling and demultiplexing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select(*keys) for s in sets]).distinct()


def intersect(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys in all sets: one shuffle, counting the sets each key is in."""
    tagged = reduce(DataFrame.union, [s.select(*keys).distinct().withColumn("_s", F.lit(i)) for i, s in enumerate(sets)])
    return tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(sets)).drop("_n")


def subtract(first: DataFrame, rest: list[DataFrame], keys: list[str]) -> DataFrame:
    return first.join(union(rest, keys), keys, "left_anti")


def shared_counts(lines: DataFrame, owner: str, line: str) -> DataFrame:
    """``(a, b, shared)`` for each two owners that share a distinct line. Lines are compared by 64-bit hashes; those of the same owners are counted before their pairs are made."""
    own = lines.filter(F.col(owner).isNotNull() & F.col(line).isNotNull()).select(F.col(owner).alias("a"), F.xxhash64(line).alias("l")).distinct()
    met = own.groupBy("l").agg(F.sort_array(F.collect_list("a")).alias("all")).filter("size(all) > 1").groupBy("all").agg(F.count(F.lit(1)).alias("n"))
    return met.select(F.posexplode("all").alias("i", "a"), "all", "n").select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("shared"))


def class_pairs(rows: DataFrame, id_column: str, keys: list[str], values: dict[str, tuple[str, str]], block: int = 1024, ways: int = 16) -> DataFrame:
    """Pairs of classes of rows that agree in ``keys``, a class being the rows with the same ``values``: both sides' values by their new names, ``_a`` and ``_b`` the ids of each (at most ``block``).

    What hangs on the values alone is found once for two classes; ``paired`` then gives the pairs of rows. Left classes are dealt in ``ways``, each with its own copy of the right ones.
    """
    split = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / block)), lambda i: F.slice("_ids", (i * block + 1).cast("int"), block))
    own = rows.filter(F.col(id_column).isNotNull()).groupBy(*keys, *values).agg(F.sort_array(F.collect_list(id_column)).alias("_ids"))
    own = own.select(*keys, *values, F.explode(split).alias("_ids"))
    dealt = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    left = own.select(*keys, *[F.col(v).alias(n[0]) for v, n in values.items()], F.col("_ids").alias("_a"), F.pmod(F.xxhash64(*values, F.get("_ids", F.lit(0))), F.lit(ways)).cast("int").alias("_way"))
    right = own.select(*keys, *[F.col(v).alias(n[1]) for v, n in values.items()], F.col("_ids").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("_way"))
    return left.repartition(dealt, *keys, "_way").join(right, [*keys, "_way"])


def paired(classes: DataFrame, *more: str) -> DataFrame:
    """``(a, b)`` with a < b of classes' pairs, and further columns of them."""
    return classes.select(F.explode("_a").alias("a"), "_b", *more).select("a", F.explode("_b").alias("b"), *more).filter("a < b")


def repair(rows: DataFrame, name: str, pair: str, payload: str) -> DataFrame:
    """``(name, one, two, paired)``: mates put together by name, whatever their order; a group-by, not a self-join."""
    out = rows.groupBy(name).agg(F.max(F.when(F.col(pair) == 0, F.col(payload))).alias("one"), F.max(F.when(F.col(pair) == 1, F.col(payload))).alias("two"))
    return out.withColumn("paired", F.col("one").isNotNull() & F.col("two").isNotNull())


def lookup(rows: DataFrame, names: DataFrame, name: str, short: Column) -> DataFrame:
    """Adds ``value`` by the full name, else by the short one where only one full name has it."""
    full = names.select(F.col("name").alias("_f"), F.col("value").alias("_v1"))
    shorts = names.groupBy(F.substring_index("name", " ", 1).alias("_s")).agg(F.min("value").alias("_v2"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    joined = rows.withColumn("_short", short).join(full, F.col(name) == F.col("_f"), "left").join(shorts, F.col("_short") == F.col("_s"), "left")
    return joined.withColumn("value", F.coalesce("_v1", "_v2")).drop("_short", "_f", "_v1", "_s", "_v2")


def sample_rows(rows: DataFrame, key: Column, fraction: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample by hash: the same rows on every run and layout."""
    from seqloom.operators.orders import hash_number

    return rows.filter(hash_number(key, seed) % 1_000_000 < int(fraction * 1_000_000))


def exact_sample(rows: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, by hash order: a top-k, not a sort of all."""
    from seqloom.operators.orders import hash_number

    return rows.orderBy(hash_number(key, seed), key).limit(n)


def partition(rows: DataFrame, ways: int, key: Column) -> DataFrame:
    return rows.withColumn("part", F.pmod(key, F.lit(ways)).cast("int"))


def demultiplex(rows: DataFrame, key: Column, least: int = 0) -> DataFrame:
    """A ``key`` column; keys with fewer than ``least`` rows become ``unknown``. Counts are joined back, so no key meets in one task."""
    keyed = rows.withColumn("key", key)
    few = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < least).select(F.col("key").alias("_k"))
    return keyed.join(few, F.col("key").eqNullSafe(F.col("_k")), "left").withColumn("key", F.when(F.col("_k").isNotNull(), F.lit("unknown")).otherwise(F.col("key"))).drop("_k")


def top_by_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """Spark limits each partition's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def closest_barcode(seen: DataFrame, expected: DataFrame, most: int, clear: int) -> DataFrame:
    """``(barcode, expected, distance)``: the nearest expected one of equal length within ``most`` and nearer by ``clear`` than the next.

    Candidates share one of ``most + clear`` pieces at its place (by the pigeonhole all within reach do), so it is an equi-join.
    """
    from seqloom.functions.sequence import hamming

    pieces = most + clear + 1

    def cut(df: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        at = [F.struct(F.lit(i).alias("i"), n.alias("n"), F.substring(F.col(c), (F.floor(n * i / pieces) + 1).cast("int"), (F.floor(n * (i + 1) / pieces) - F.floor(n * i / pieces)).cast("int")).alias("p")) for i in range(pieces)]
        return df.select(c, F.explode(F.array(*at)).alias("piece"))

    a = cut(seen.select(F.col("barcode")).distinct(), "barcode")
    b = cut(expected.select(F.col("barcode").alias("expected")).distinct(), "expected").withColumnRenamed("piece", "piece2")
    pairs = a.join(b, F.col("piece") == F.col("piece2")).select("barcode", "expected").distinct().withColumn("distance", hamming(F.col("barcode"), F.col("expected"))).filter(F.col("distance") < most + clear + 1)
    w = W.partitionBy("barcode").orderBy("distance", "expected")
    ranked = pairs.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("distance").over(w))
    return ranked.filter((F.col("_r") == 1) & (F.col("distance") <= most) & (F.col("_next").isNull() | (F.col("_next") - F.col("distance") >= clear))).select("barcode", "expected", "distance")
