"""Formats by name and by first line."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of each format.
ENDINGS = {
    "fastq": "fq fastq",
    "fasta": "fa fasta fna ffn fas faa",
    "sam": "sam",
    "bam": "bam",
    "vcf": "vcf",
    "gff": "gff gff3 gtf",
    "bed": "bed",
    "oneline": "oneline",
    "scarf": "scarf",
    "gfa": "gfa",
    "genbank": "gb gbk gbff genbank embl",
    "phylip": "phy phylip",
    "json": "json jsonl",
    "parquet": "parquet",
    "csv": "csv",
    "tsv": "tsv txt",
}
COMPRESSED = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")
_FORMAT = {ending: name for name, endings in ENDINGS.items() for ending in endings.split()}


def detect(path: str, first_line: str | None = None) -> tuple[str, str | None]:
    """(format, compression) by ending; an unknown ending falls to the first line."""
    parts = path.rstrip("/").lower().rsplit("/", 1)[-1].split(".")
    packed = parts.pop() if parts[-1] in COMPRESSED else None
    found = _FORMAT.get(parts[-1]) if len(parts) > 1 else None
    if found is None and first_line is not None:
        tests = (("vcf", r"##fileformat=VCF"), ("gff", r"##gff-version"), ("sam", r"@(HD|SQ|RG|PG|CO)\t"), ("fastq", r"@"), ("fasta", r">"), ("genbank", r"(LOCUS|ID) "), ("json", r"[{\[]"), ("gfa", r"[HSL]\t"))
        found = next((name for name, pattern in tests if re.match(pattern, first_line)), None)
    return found or "text", packed


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Any format by its reader; Spark takes care of compression."""
    from seqloom.sources import bam, readers

    kind, _ = detect(path)
    if kind == "text":
        first = spark.read.text(path).limit(1).collect()
        kind, _ = detect(path, first[0][0] if first else "")
    if kind in ("parquet", "csv", "tsv", "text"):
        return spark.read.parquet(path) if kind == "parquet" else spark.read.text(path) if kind == "text" else spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    return getattr(bam if kind == "bam" else readers, f"read_{kind}")(spark, path, **options)


def sniff(reads: DataFrame) -> DataFrame:
    """One row about reads: numbers, range of lengths and qualities, pairing, distinct names (about)."""
    has = set(reads.columns)
    out = [F.count(F.lit(1)).alias("reads"), F.min(F.length("bases")).alias("min_length"), F.max(F.length("bases")).alias("max_length"), F.approx_count_distinct("id").alias("names")]
    if "quals" in has:
        out += [F.min(F.array_min("quals")).alias("min_quality"), F.max(F.array_max("quals")).alias("max_quality")]
    if "pairnum" in has:
        out.append((F.max("pairnum") > 0).alias("paired"))
    return reads.agg(*out)
