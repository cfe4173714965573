"""Sinks. Each writes a folder of part files, as Spark does; order is the frame's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def _text(df: DataFrame, path: str, compression: str | None) -> None:
    (df.write.option("compression", compression) if compression else df.write).text(path)


def write_fastq(reads: DataFrame, path: str, offset: int = 33, compression: str | None = None) -> None:
    _text(reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "bases", F.lit("+"), S.phred_text(F.col("quals"), offset))), path, compression)


def write_fasta(reads: DataFrame, path: str, wrap: int = 70, compression: str | None = None) -> None:
    lines = F.regexp_replace("bases", f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else F.col("bases")
    _text(reads.select(F.concat(F.lit(">"), "id", F.lit("\n"), lines)), path, compression)


def write_sam(rows: DataFrame, path: str, compression: str | None = None) -> None:
    from seqloom.sources.readers import SAM_FIELDS

    tags = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])) if "tags" in rows.columns else F.array().cast("array<string>")
    _text(rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in SAM_FIELDS], tags)), path, compression)


def write_vcf(rows: DataFrame, path: str, compression: str | None = None, samples: list[str] | None = None) -> None:
    """Sorted by scaffold and position over range partitions; the header is the first file's first lines. With names of ``samples`` the format and sample columns are written too, else left out."""
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    more = [dot("format"), F.array_join("samples", "\t")] if samples else []
    body = rows.orderBy("scaf", "pos").select(F.concat_ws("\t", "scaf", dot("pos"), dot("id"), "ref", "alt", dot("qual"), dot("filter"), info, *more))
    names = "".join(f"\t{x}" for x in ["FORMAT", *samples]) if samples else ""
    header = rows.sparkSession.createDataFrame([(f"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO{names}",)], "v string")
    _text(header.coalesce(1).union(body), path, compression)


def write_bed(rows: DataFrame, path: str, compression: str | None = None) -> None:
    _text(rows.orderBy("scaf", "start").select(F.concat_ws("\t", "scaf", F.col("start").cast("string"), F.col("stop").cast("string"))), path, compression)


def write_gff(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """Nine columns; ``attributes`` is a map."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    attributes = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    _text(rows.orderBy("seqid", "start").select(F.concat_ws("\t", *[dot(c) for c in ("seqid", "source", "type", "start", "stop", "score", "strand", "phase")], attributes)), path, compression)


def write_stats_json(statistics: DataFrame, path: str) -> None:
    """A statistics table as one JSON document a row."""
    statistics.coalesce(1).write.json(path)


def write(df: DataFrame, path: str, kind: str, by: str | None = None, **options) -> None:
    """By format; with ``by`` one folder a key, all keys in one pass. ``null`` computes and discards."""
    if kind == "null":
        df.write.format("noop").mode("overwrite").save()
    elif kind in ("fastq", "fasta", "sam", "vcf", "bed", "gff"):
        globals()[f"write_{kind}"](df, path, **options)
    else:
        writer = df.repartition(by).write.partitionBy(by) if by else df.write
        writer.format(kind).options(**options).save(path)
