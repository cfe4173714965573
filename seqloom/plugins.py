"""Interfaces to put own code into the library's plans: row processors, mergeable accumulators, aligners, distinct counters, orders, line parsers, jobs.

Each takes plain functions or small classes and puts them where Spark runs them: expressions stay
expressions, Python runs over Arrow batches, accumulators are merged as partial aggregates are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RowProcessor(Protocol):
    """A step over whole tables; ``process`` is called once, when the plan is made."""

    def process(self, rows: DataFrame) -> DataFrame: ...


class BatchProcessor(Protocol):
    """A step over Arrow batches; ``process`` runs on executors, ``schema`` says what comes out."""

    schema: T.StructType | str

    def process(self, batch: pa.RecordBatch) -> pa.RecordBatch | None: ...


def run_chain(rows: DataFrame, steps: Iterable[RowProcessor | BatchProcessor | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rows through the steps in order: table steps and functions by calling them, batch steps by ``mapInArrow``."""
    for step in steps:
        if hasattr(step, "schema"):

            def run(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = step.process(batch)
                    if out is not None and out.num_rows:
                        yield out

            rows = rows.mapInArrow(run, step.schema)
        else:
            rows = step.process(rows) if hasattr(step, "process") else step(rows)
    return rows


class Accumulator(Protocol):
    """A value that is built from batches and put together: ``merge`` must not hang on order or grouping."""

    def add(self, batch: pa.RecordBatch) -> None: ...

    def merge(self, other: bytes) -> None: ...

    def state(self) -> bytes: ...


def accumulate(rows: DataFrame, make: Callable[[], Accumulator], fan: int = 16) -> Accumulator:
    """One accumulator over all rows: one a partition, merged by a tree of tasks; the last ``fan`` states at most come to the driver."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = make(), False
        for batch in batches:
            own.add(batch)
            some = True
        if some:
            yield pa.RecordBatch.from_pydict({"state": pa.array([own.state()], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = make(), False
        for batch in batches:
            for state in batch.column(0).to_pylist():
                own.merge(state)
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"state": pa.array([own.state()], pa.binary())})

    parts = rows.rdd.getNumPartitions()
    states = rows.mapInArrow(build, "state binary")
    while parts > fan:
        parts = -(-parts // fan)
        states = states.repartition(parts).mapInArrow(join, "state binary")
    out = make()
    for row in states.collect():
        out.merge(bytes(row.state))
    return out


_ALIGNERS: dict[str, Callable[[str, str], tuple[float, int, int]]] = {}


def aligner(name: str):
    """Registers ``f(query, target) -> (identity, start, stop)`` under a name."""

    def add(f):
        _ALIGNERS[name] = f
        return f

    return add


@aligner("global")
def _global(query: str, target: str) -> tuple[float, int, int]:
    from seqloom.operators.alignment import align

    _, same, columns, start, stop = align(query, target)
    return (same / columns if columns else 0.0), start, stop


@aligner("glocal")
def _glocal(query: str, target: str) -> tuple[float, int, int]:
    from seqloom.operators.alignment import align

    _, same, columns, start, stop = align(query, target, "glocal")
    return (same / columns if columns else 0.0), start, stop


@aligner("hamming")
def _hamming(query: str, target: str) -> tuple[float, int, int]:
    if len(query) != len(target) or not query:
        return 0.0, 0, 0
    return sum(a == b for a, b in zip(query, target, strict=True)) / len(query), 0, len(target)


def align_with(pairs: DataFrame, name: str, query: str, target: str) -> DataFrame:
    """Adds ``identity, start, stop`` by the aligner of that name; null strings give nulls."""
    f, names = _ALIGNERS[name], pairs.columns
    at = names.index(query), names.index(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None, None) if a is None or b is None else f(a, b) for a, b in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True)]
            identity, start, stop = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(identity, pa.float64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=[*names, "identity", "start", "stop"])

    more = [T.StructField("identity", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]
    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, *more]))


_COUNTERS: dict[str, Callable[[DataFrame, str], Column | DataFrame]] = {}


def distinct_counter(name: str):
    """Registers ``f(rows, key) -> frame of one row, estimate`` under a name."""

    def add(f):
        _COUNTERS[name] = f
        return f

    return add


@distinct_counter("exact")
def _exact(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.countDistinct(key).cast("double").alias("estimate"))


@distinct_counter("hll")
def _hll(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg(key)).cast("double").alias("estimate"))


@distinct_counter("registers")
def _registers(rows: DataFrame, key: str) -> DataFrame:
    from seqloom.operators.counting import register_estimate, registers

    return register_estimate(registers(rows.withColumn("_all", F.lit(0)), "_all", F.col(key)), None)


def count_distinct(rows: DataFrame, key: str, name: str = "hll") -> DataFrame:
    return _COUNTERS[name](rows, key)


_ORDERS: dict[str, Callable[[], list[Column]]] = {}


def order(name: str):
    """Registers a function that gives sort columns under a name."""

    def add(f):
        _ORDERS[name] = f
        return f

    return add


# The built-in orders over reads (id, bases, quals, pairnum) and alignments (scaf, pos, flag).
order("name")(lambda: [F.col("id"), F.col("pairnum")])
order("length")(lambda: [F.length("bases").desc(), F.col("id")])
order("sequence")(lambda: [F.col("bases"), F.col("id")])
order("position")(lambda: [F.col("scaf").asc_nulls_last(), F.col("pos"), F.col("flag").bitwiseAND(16)])


@order("quality")
def _by_quality() -> list[Column]:
    from seqloom.functions.sequence import expected_errors

    return [expected_errors(F.col("quals")) / F.greatest(F.size("quals"), F.lit(1)), F.col("id")]


def ordered(rows: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Rows in the order of that name, or the reverse of it."""
    columns = _ORDERS[name]()
    if not descending:
        return rows.orderBy(*columns)
    from seqloom.operators.rows import numbered

    return numbered(rows, columns, "_place").orderBy(F.col("_place").desc()).drop("_place")


def parse_lines(spark: SparkSession, path: str | list[str], parse: Callable[[str], dict[str, Any] | None], schema: str) -> DataFrame:
    """Lines of text through an own parser, batch by batch; lines it gives None for are left out."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema).fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in map(parse, batch.column(0).to_pylist()) if r is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in kinds.items()], names=list(kinds))

    return spark.read.text(path).mapInArrow(run, schema)


def run_jobs(jobs: dict[str, Callable[[], Any]], threads: int = 4) -> dict[str, Any]:
    """Independent Spark jobs side by side; the first error is raised once all are done."""
    with ThreadPoolExecutor(threads) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
    return {name: future.result() for name, future in running.items()}
