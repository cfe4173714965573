"""Repeated passages by sparse suffix arrays.

Words are runs of anything but white space, compared exactly. From each text only
the suffixes that start at minimisers are kept: of each ``STRETCH`` neighbouring
runs of ``GRAM`` words the one with the least hash. The choice follows the content,
so each run of ``least`` words has one anchor, the minimiser of its first words, at
the same place in all its copies; a suffix is the anchor of a few neighbouring runs,
and all of these lie within its context, some words to its left and right.

The suffixes are sorted over the cluster by their first words, then by their context,
and neighbours are compared. Where first words and context agree, the match extends
over the whole context: all runs of the later suffix repeat. Where the first words
agree and the contexts don't, as at the ends of passages, the match is extended left
and right word by word: the first suffix of each such context gives its runs, each
written out to its whole length, and these are sorted and compared with their
neighbours. Overlapping repeats are put together to whole passages.

Words are compared by two independent 64-bit hashes of the words in place, 128 bits.
But for clashes of these the result is exact: the words in some run of ``least`` words
that stands earlier, by (doc_id, hash of the text, position), too.

Sorting includes (doc_id, hash of the text, position), so a passage that a third of the
rows share is spread over partitions; what meets at a partition's edge is told apart
by the second comparison, whose own edges are compared afterwards.

Defined results: null and short texts repeat nothing; passages repeated within one
text count; rows with the same id (or none) and the same text count as one text read
again, not as a repeat of itself, and other rows are texts of their own, whatever
their ids; a null id counts as the least one and comes back as null. An empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import NULL_ID, checkpoint, fresh, map_batches, mix64, partitions, row_id, span_hashes, table, text_hash, texts_of, whole_rows, window_hashes, word_hashes

#: For passages of at least 50 words; both give way to shorter ones.
GRAM, STRETCH = 16, 25


def shape(least: int) -> tuple[int, int]:
    """(gram, stretch) with gram + stretch <= least + 1."""
    return (GRAM, STRETCH) if least >= GRAM + STRETCH - 1 else (max(1, least // 3), max(1, least // 2))


def anchors(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the kept suffixes, first run, last run anchored at each); every run of ``least`` words has one anchor."""
    gram, stretch = shape(least)
    runs = len(words) - least + 1
    views = np.lib.stride_tricks.sliding_window_view(window_hashes(words, gram), stretch)[:runs]
    at = np.concatenate([views[a : a + 65536].argmin(1) + np.arange(a, min(a + 65536, runs)) for a in range(0, runs, 65536)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], runs] - 1


def other_hashes(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each word, for sums independent of those over the first."""
    return mix64(hashes ^ np.uint64(0xA0761D6478BD642F))


_SUFFIX = "key long, context long, doc_id long, row long, place long"


def placed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One number, ordered as the positions: a suffix's position, and how far before it its first and last run begin (under 2**8)."""
    return at << 16 | at - low << 8 | at - high


def sparse_suffixes(docs: DataFrame, least: int) -> DataFrame:
    """The kept suffixes of ``docs(doc_id, row, text)``: hashes of first words and of the context, and where they and their runs are."""
    depth = least - shape(least)[1] + 1

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts: list[list] = [[] for _ in range(5)]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                words = text.split()
                if len(words) < least:
                    continue
                hashes = word_hashes(words)
                at, low, high = anchors(hashes, least)
                context = span_hashes(other_hashes(hashes), low, high + least)
                shaped = mix64(context + ((at - low) * 65536 + (high - low)).astype(np.uint64))
                own = (span_hashes(hashes, at, at + depth).view(np.int64), shaped.view(np.int64), np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), placed(at, low, high))
                for part, values in zip(parts, own, strict=True):
                    part.append(values)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=[c.split()[0] for c in _SUFFIX.split(", ")]) if parts[0] else None

        return run

    return map_batches(docs, make, _SUFFIX)


def compared(suffixes: DataFrame) -> DataFrame:
    """``(doc_id, row, low, high, first_id)`` of runs that repeat, and with ``first_id`` null of runs still to be extended.

    Sorted by first words and context; within a partition a suffix that isn't the first with its first
    words and context repeats, and the first is to be extended if its first words have another context.
    The first words a partition begins or ends with may go on beyond it and count as having another.
    """
    order = ["key", "context", "doc_id", "row", "place"]
    ordered = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *order).sortWithinPartitions(*order)

    def out(doc, row, place, first=None) -> pa.RecordBatch:
        at = place >> 16
        low, high = at - (place >> 8 & 255), at - (place & 255)
        first = pa.nulls(len(doc), pa.int64()) if first is None else pa.array(first, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), first], names=["doc_id", "row", "low", "high", "first_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # key, context, doc, row, place of the present context's first
        pending = None  # it, where it is the only one so far with its first words
        for batch in batches:
            if not batch.num_rows:
                continue
            key, context, doc, row, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            begins = head is None
            new_key = np.r_[begins or head[0] != key[0], key[1:] != key[:-1]]
            new = new_key | np.r_[begins or head[1] != context[0], context[1:] != context[:-1]]
            starts = np.flatnonzero(np.r_[True, new[1:]])
            of = np.cumsum(np.r_[True, new[1:]]) - 1
            hd, hr, hp = doc[starts].copy(), row[starts].copy(), place[starts].copy()
            if not new[0]:
                hd[0], hr[0], hp[0] = head[2:]
            later = (doc != hd[of]) | (row != hr[of]) | (place != hp[of])
            if later.any():
                yield out(doc[later], row[later], place[later], hd[of[later]])
            head = (int(key[-1]), int(context[-1]), int(hd[-1]), int(hr[-1]), int(hp[-1]))
            heads = np.flatnonzero(new)
            if not len(heads):
                continue
            alone = new_key[heads]  # the first with its first words; alone unless one more follows
            if pending is not None and not alone[0]:
                yield out(*pending)
            alone[:-1] &= alone[1:]
            alone[0] &= not begins
            given = heads[~alone]
            if len(given):
                yield out(doc[given], row[given], place[given])
            last = heads[-1:]
            pending = (doc[last], row[last], place[last]) if alone[-1] else None
        if pending is not None:
            yield out(*pending)

    return checkpoint(ordered.mapInArrow(run, "doc_id long, row long, low int, high int, first_id long"))


def runs_of(docs: DataFrame, open_: DataFrame, least: int) -> DataFrame:
    """``(key, other, doc_id, row, pos)`` of each run of ``least`` words anchored at the suffixes ``open_(doc_id, row, low, high)``."""
    places = open_.groupBy("doc_id", "row").agg(F.collect_list(F.struct("low", "high")).alias("places"))
    joined = docs.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts: list[list] = [[] for _ in range(5)]
            for doc, row, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3), strict=True):
                hashes = word_hashes(text.split())
                low, high = (at.values.field(i).to_numpy().astype(np.int64) for i in range(2))
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, low, 1)
                np.add.at(change, high + 1, -1)
                starts = np.flatnonzero(np.cumsum(change) > 0)
                keys = span_hashes(hashes, starts, starts + least), span_hashes(other_hashes(hashes), starts, starts + least)
                own = (keys[0].view(np.int64), keys[1].view(np.int64), np.full(len(starts), doc, np.int64), np.full(len(starts), row, np.int64), starts.astype(np.int32))
                for part, values in zip(parts, own, strict=True):
                    part.append(values)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["key", "other", "doc_id", "row", "pos"])

        return run

    return checkpoint(map_batches(joined, make, "key long, other long, doc_id long, row long, pos int", rows=128))


def later_copies(runs: DataFrame) -> DataFrame:
    """``(doc_id, row, low, high, first_id)`` of the runs that aren't the first of their like; ``first_id`` is the document of the first."""
    order = ["key", "other", "doc_id", "row", "pos"]
    ordered = runs.repartitionByRange(partitions(runs.sparkSession), *order).sortWithinPartitions(*order)
    schema = "doc_id long, row long, pos int, first_id long, edge int, key long, other long, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = None  # the first run of the partition: key, other, doc, row, pos
        head = None  # the first of the present one's like

        def out(docs, rows, places, firsts, edge=0, keys=(0, 0)):
            size = len(docs)
            columns = [pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(firsts, pa.int64()), pa.array(np.full(size, edge), pa.int32()), pa.array(np.full(size, keys[0], np.int64)), pa.array(np.full(size, keys[1], np.int64)), pa.array(np.full(size, part), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, other, doc, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])])
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
            hd, hr, hp = doc[starts].copy(), row[starts].copy(), pos[starts].copy()
            if head is not None and head[:2] == (key[0], other[0]):
                hd[0], hr[0], hp[0] = head[2:]
            if first is None:
                first = int(key[0]), int(other[0]), int(doc[0]), int(row[0]), int(pos[0])
            later = (doc != hd[of]) | (row != hr[of]) | (pos != hp[of])
            if later.any():
                yield out(doc[later], row[later], pos[later], hd[of[later]])
            head = int(key[-1]), int(other[-1]), int(hd[-1]), int(hr[-1]), int(hp[-1])
        if first is not None:
            yield out([first[2]], [first[3]], [first[4]], [first[2]], 1, first[:2])
            yield out([head[2]], [head[3]], [head[4]], [head[2]], 2, head[:2])

    found = checkpoint(ordered.mapInArrow(run, schema))
    # Two rows a partition: where a like goes on from the partition before, its first row here repeats too.
    order = W.orderBy("part", "edge")
    same = (F.lag("key").over(order) == F.col("key")) & (F.lag("other").over(order) == F.col("other"))
    edges = found.filter("edge > 0").withColumn("new", F.when(same, 0).otherwise(1)).withColumn("like", F.sum("new").over(order))
    whole = W.partitionBy("like").orderBy("part", "edge")
    heads = {c: F.first(c).over(whole) for c in ("doc_id", "row", "pos")}
    edges = edges.select("*", *[v.alias(f"head_{k}") for k, v in heads.items()])
    crossing = edges.filter((F.col("doc_id") != F.col("head_doc_id")) | (F.col("row") != F.col("head_row")) | (F.col("pos") != F.col("head_pos")))
    every = found.filter("edge = 0").select("doc_id", "row", "pos", "first_id").union(crossing.select("doc_id", "row", "pos", "head_doc_id"))
    return every.select("doc_id", "row", F.col("pos").alias("low"), F.col("pos").alias("high"), "first_id")


def row_spans(docs: DataFrame, least: int) -> DataFrame:
    """``(doc_id, row, start, end, first_id)``, ids and rows as in ``whole_rows``."""
    plain = docs.select(row_id().alias("doc_id"), text_hash().alias("row"), F.col("text").cast("string").alias("text"))
    found = compared(checkpoint(sparse_suffixes(plain, least)))
    repeats = found.filter("first_id is not null").union(later_copies(runs_of(plain, found.filter("first_id is null"), least)))
    by_doc = W.partitionBy("doc_id", "row").orderBy("low", "high")
    marked = repeats.withColumn("new", F.when(F.col("low") - F.lag("high").over(by_doc) <= least, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy("doc_id", "row", "run").agg(F.min("low").alias("start"), (F.max("high") + least).alias("end"), F.min("first_id").alias("first_id")).drop("run")


def passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """``(doc_id, first_id, start, end)``, in words, end exclusive: a row a repeated passage; ``first_id`` has it earlier, in whole or in part."""

    def real(c: str):
        return F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)

    return row_spans(docs, least).select(real("doc_id"), real("first_id"), "start", "end")


_WORD = re.compile(r"\S+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in spans, each with the white space after it."""
    ends = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : ends[start]])
        at = ends[end]
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence cut out; rows left without a word go."""
    spans = row_spans(docs, least).groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_text")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = whole_rows(docs).join(spans, (F.col("id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_text")), "left")
    plain = joined.filter("spans is null").select("row.*")
    names = docs.columns
    todo = joined.filter("spans is not null").select("row.*", F.col("spans").alias(fresh("spans", names)))

    def make():
        at = names.index("text")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(texts_of(batch.column(at)), spans, strict=True)]
            left = pa.array([bool(t.strip()) for t in texts])
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            return pa.RecordBatch.from_arrays(columns, names=names).filter(left)

        return run

    changed = map_batches(todo, make, docs.schema, rows=128)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return plain.union(changed)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents")).select("doc_id", "first_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
