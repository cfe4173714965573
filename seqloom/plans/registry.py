"""Where queries over the driver tables are registered with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequence as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers ``f(tables)``; ``tables("orders")`` is that table's frame."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


#: Documents stand in for reads: their letters A, C, G, T and N, and qualities made from places.
READS = """reads AS (SELECT doc_id AS id, source, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS bases FROM documents WHERE text IS NOT NULL)"""
QUALS = READS + """, q AS (SELECT *, list_transform(range(len(bases)), lambda i: CAST((i * 7 + (i % 31) * (i % 17) + len(bases)) % 41 AS INTEGER)) AS quals FROM reads WHERE len(bases) > 0)"""
WORDS = """words AS (SELECT doc_id AS id, source, list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"""


def reads(t) -> DataFrame:
    return t("documents").filter("text is not null").select(F.col("doc_id").alias("id"), "source", S.once(F.regexp_replace(F.upper("text"), "[^ACGTN]", "")).alias("bases"))


def quals(t) -> DataFrame:
    def made(n):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i * 7 + (i % 31) * (i % 17) + n) % 41).cast("int"))

    return reads(t).filter(F.length("bases") > 0).select("*", S.once(S.let(F.length("bases"), made)).alias("quals"))


def words(t) -> DataFrame:
    return t("documents").filter("text is not null").select(F.col("doc_id").alias("id"), "source", S.once(F.filter(F.split(F.lower("text"), "[ \\t\\n]+"), lambda x: x != "")).alias("w"))


def kmer_sql(k: int, source: str = "reads") -> str:
    """SQL of ``(id, pos, kmer)`` of defined k-mers."""
    return f"(SELECT id, i - 1 AS pos, substring(bases, i, {k}) AS kmer FROM (SELECT id, bases, unnest(range(1, len(bases) - {k} + 2)) AS i FROM {source}) WHERE regexp_full_match(substring(bases, i, {k}), '[ACGT]*'))"
