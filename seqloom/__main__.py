"""Command line: ``python -m seqloom TOOL in=PATH out=PATH key=value ...``; values take k, m and g, t and f.

Tools: reformat, filter, trim, stats, count, dedupe, sort, sample, convert, query.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import sources
from seqloom.functions import sequence as S
from seqloom.operators import aggregates, complexity, orders, packed, rows
from seqloom.plugins import ordered
from seqloom.sources import writers


def parsed(arguments: list[str]) -> dict[str, str]:
    """``key=value`` words; a word without ``=`` is on."""
    return {k.lower().lstrip("-"): (v if sep else "t") for k, sep, v in (a.partition("=") for a in arguments)}


def number(options: dict[str, str], name: str, default: float | None = None) -> float | None:
    text = options.get(name)
    if text is None:
        return default
    scale = {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12}.get(text[-1:].lower())
    return float(text[:-1]) * scale if scale else float(text)


def on(options: dict[str, str], name: str) -> bool:
    return options.get(name, "f").lower() in ("t", "true", "1")


def reads(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    return sources.read(spark, o["in"])


def filtered(df: DataFrame, o: dict[str, str]) -> DataFrame:
    most = number(o, "maxlength")
    return rows.filter_chain(
        df, min_length=int(number(o, "minlength", 0)), max_length=int(most) if most else None, min_gc=number(o, "mingc", 0.0), max_gc=number(o, "maxgc", 1.0),
        max_ns=int(number(o, "maxns")) if "maxns" in o else None, min_quality=number(o, "minavgquality"), quals="quals" if "quals" in df.columns else None,
    )


def trimmed(df: DataFrame, o: dict[str, str]) -> DataFrame:
    return rows.quality_trim(df, o.get("mode", "optimal"), number(o, "trimq", 6)) if "quals" in df.columns else df


def reformat(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    df = reads(spark, o)
    if on(o, "rcomp"):
        df = df.withColumn("bases", S.reverse_complement(F.col("bases")))
        df = df.withColumn("quals", F.reverse("quals")) if "quals" in df.columns else df
    if "trimq" in o:
        df = trimmed(df, o)
    if "entropy" in o:
        df = complexity.windowed(df, least=number(o, "entropy")).filter(F.col("low_entropy") >= number(o, "entropy")).drop("low_entropy", "mean_entropy", "low_bases")
    return filtered(df, o)


def stats(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    return aggregates.nx_lx(reads(spark, o).select(F.length("bases").alias("length")), "length")


def count(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    k = int(number(o, "k", 31))
    found = packed.counts(reads(spark, o), "bases", k, canonical=not on(o, "stranded"), least=int(number(o, "mincount", 1)))
    return found.select(S.unpacked_kmer(F.col("key"), k).alias("kmer"), "n")


def dedupe(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    df = reads(spark, o)
    return aggregates.best_copy(df.withColumn("_c", S.canonical(F.col("bases"))), ["_c"], F.col("id")).drop("_c")


def sort(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    return ordered(reads(spark, o), o.get("by", "length"), on(o, "reverse"))


def sample(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    df = reads(spark, o)
    if "samplereadstarget" in o:
        return df.orderBy(orders.hash_number(F.col("id"), int(number(o, "seed", 0))), "id").limit(int(number(o, "samplereadstarget")))
    if "samplebasestarget" in o:
        return orders.sample_bases(df, F.col("id"), F.length("bases"), int(number(o, "samplebasestarget")), int(number(o, "seed", 0)))
    return df.filter(orders.hash_number(F.col("id"), int(number(o, "seed", 0))) % 1_000_000 < int(1_000_000 * number(o, "samplerate", 1.0)))


def query(spark: SparkSession, o: dict[str, str]) -> DataFrame:
    """A registered query over a folder of tables."""
    from seqloom.plans import QUERIES

    return QUERIES[o["name"]](spark, o["in"])


TOOLS = {
    "reformat": reformat, "convert": reads, "filter": lambda s, o: filtered(reads(s, o), o), "trim": lambda s, o: filtered(trimmed(reads(s, o), o), o),
    "stats": stats, "count": count, "dedupe": dedupe, "sort": sort, "sample": sample, "query": query,
}


def kind_of(path: str, df: DataFrame) -> str:
    name = path.removesuffix(".gz").removesuffix(".bz2").rsplit(".", 1)[-1].lower()
    known = {"fq": "fastq", "fastq": "fastq", "fa": "fasta", "fasta": "fasta", "fna": "fasta", "sam": "sam", "vcf": "vcf", "json": "json", "csv": "csv"}
    return known.get(name, "parquet")


def main(arguments: list[str], spark: SparkSession | None = None) -> DataFrame:
    if not arguments or arguments[0] not in TOOLS:
        sys.exit(__doc__)
    o = parsed(arguments[1:])
    df = TOOLS[arguments[0]](spark or SparkSession.builder.getOrCreate(), o)
    if "out" in o:
        writers.write(df, o["out"], kind_of(o["out"], df))
    else:
        df.show(int(number(o, "rows", 20)), truncate=False)
    return df


if __name__ == "__main__":
    main(sys.argv[1:])
