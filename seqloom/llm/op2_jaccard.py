"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Each text becomes the set of its runs of five lower-cased white-space words (a
shorter text is one run). Equal sets are one class from the start. Band and row
counts are chosen for a target recall at the threshold; class representatives meet
by band hash, the buckets they share are put together to groups by connected
components, and each group's texts are compared in full. A group larger than a
block is cut in blocks by hash and each pair of blocks is a task of its own, which
returns sums for its members and a spanning forest, never pairs. So a document's
links are counted against all documents, and no group need fit in one task.

Result: a row a document with its class (the least id of the documents joined to
it by a chain of links) and its number of links (other documents whose Jaccard
similarity is at least the threshold).

Defined results: null, empty and blank texts have no n-grams: their class is their
own id and they have no links. Rows with the same id, or none, are documents of their
own and stay rows of their own: rows are told by their id and a hash of their text,
never by the id alone. A null id gives a null class unless the class holds another
id. An empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import NULL_ID, checkpoint, components, map_batches, mix64, partitions, row_id, spread_join, table, text_hash, texts_of, whole_rows, window_hashes, word_hashes

#: Representatives in a block, and characters of theirs, at most about.
BLOCK_ROWS = 256
BLOCK_CHARS = 4_000_000


def choose_bands(threshold: float, recall: float, hashes: int = 360) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which ``hashes`` values reach the recall at the threshold, and as few bands as do."""
    for rows in range(20, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding reaches the recall")


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of all words if fewer; none without words."""
    hashes = word_hashes(text.lower().split())
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(n, len(hashes))))


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits of a set; empty for the empty set."""
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else b""


def signature(own: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    low = (own >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(len(multipliers), np.uint32(2**32 - 1))
    for at in range(0, len(low), 1024):
        np.minimum(out, (low[at : at + 1024] * multipliers).min(0), out=out)
    return out


def features(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``(id, text_hash, fp binary, chars, bands array<long>)`` of ``docs(id, text_hash, text)``."""

    def make():
        rng = np.random.default_rng(5)
        multipliers = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        salt = rng.integers(0, 2**62, (bands, rows + 1), np.uint64) * np.uint64(2) + np.uint64(1)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints, keys, offsets, chars = [], [], [0], []
            for text in texts_of(batch.column(2)):
                own = shingles(text, n)
                prints.append(fingerprint(own))
                chars.append(len(text))
                if len(own):
                    parts = signature(own, multipliers).reshape(bands, rows).astype(np.uint64) + np.uint64(1)
                    keys.append(mix64((parts * salt[:, :rows]).sum(1) + salt[:, rows]).view(np.int64))
                offsets.append(offsets[-1] + bands * (len(own) > 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            return pa.RecordBatch.from_pydict({"id": batch.column(0), "text_hash": batch.column(1), "fp": pa.array(prints, pa.binary()), "chars": pa.array(chars, pa.int64()), "bands": lists})

        return run

    return map_batches(docs, make, "id long, text_hash long, fp binary, chars long, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal (root, i, j), which arrive in order."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["root"], row["i"], row["j"])
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append(row)
    if rows:
        yield key, rows


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, columns: int = 4_000_000) -> np.ndarray:
    """Whether sets[left[a]] and sets[right[b]] are at least as similar as the threshold, from their exact intersections."""
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[place] > 1
    owner, place = owner[keep], (np.cumsum(times > 1) - 1)[place[keep]]
    n, wide = int((times > 1).sum()), max(256, columns // len(sets))
    common = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, n, wide):
        a, b = np.searchsorted(place, (at, at + wide))
        held = np.zeros((len(sets), min(wide, n - at)), np.float32)
        held[owner[a:b], place[a:b] - at] = 1
        common += held[left] @ held[right].T
    return common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9


def verified(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """``(fp, links, root)`` for each task's members: copies linked to, and the least member of the task linked by a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches):
            members: dict[bytes, tuple] = {}
            for r in rows:
                own = shingles(r["text"], n)
                if fingerprint(own) == r["fp"]:
                    members[r["fp"]] = (r["own"], own, r["copies"])
            prints = sorted(members)
            if len(prints) < 2:
                continue
            blocks = np.array([members[p][0] for p in prints])
            copies = np.array([members[p][2] for p in prints], np.int64)
            left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
            if not len(left) or not len(right):
                continue
            near = compare([members[p][1] for p in prints], left, right, threshold)
            links = np.zeros(len(prints), np.int64)
            if i == j:
                np.fill_diagonal(near, False)
                links[left] = near @ copies[right]
            else:
                links[left] += near @ copies[right]
                links[right] += near.T @ copies[left]
            root = list(range(len(prints)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(*np.nonzero(near), strict=True):
                x, y = find(int(left[a])), find(int(right[b]))
                if x != y:
                    root[max(x, y)] = min(x, y)
            linked = np.flatnonzero(links).tolist()
            if linked:
                yield pa.RecordBatch.from_pydict({"fp": pa.array([prints[x] for x in linked], pa.binary()), "links": pa.array(links[linked]), "root": pa.array([prints[find(x)] for x in linked], pa.binary())})

    return pairs.mapInArrow(run, "fp binary, links long, root binary")


def rows_in_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """``(id, text_hash, first, class_id, n_links)``, a row a row of ``docs``; ``first`` says whether the row, or one equal to it, is the first of its class."""
    bands, rows = choose_bands(threshold, recall)
    plain = docs.select(row_id().alias("id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = checkpoint(features(plain, n, bands, rows))
    some = F.length("fp") > 0
    own_rows = F.struct((F.col("id") == NULL_ID).alias("none"), "id", "text_hash")  # rows with an id come first
    reps = checkpoint(found.filter(some).groupBy("fp").agg(F.min(own_rows).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("chars").alias("chars"), F.first("bands").alias("bands")))
    held = reps.select("fp", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "fp")
    shared = checkpoint(held.groupBy("bucket").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("bucket").alias("b"), "least", "n"))
    # Each set points to the least of its buckets' least sets, and that joins the others: as these are shared by many, few distinct edges are left.
    met = spread_join(held, shared.drop("n"), "bucket", "b", counts=shared.select(F.col("b").alias("key"), "n"))
    met = met.groupBy("fp").agg(F.array_sort(F.collect_set("least")).alias("leasts"))  # one a band at most
    edges = met.select(F.explode(F.concat(F.array("fp"), F.slice("leasts", 2, bands))).alias("a"), F.col("leasts")[0].alias("b")).filter("a <> b").distinct()
    grouped = components(edges).withColumnRenamed("node", "fp")
    sized = checkpoint(grouped.join(reps.select("fp", "rep", "copies", "chars"), "fp"))
    blocks = checkpoint(sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks")))
    placed = spread_join(sized, blocks.select(F.col("root").alias("of_root"), "blocks"), "root", "of_root", counts=blocks.select(F.col("root").alias("key"), "n"))
    wanted = placed.select(F.col("rep.id").alias("id"), F.col("rep.text_hash").alias("text_hash"), "fp", "copies", "root", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("own"))
    if found.groupBy("id", "text_hash").count().filter("count > 1").limit(1).count():
        plain = plain.groupBy("id", "text_hash").agg(F.first("text").alias("text"))  # equal rows: one text of them
    texts = wanted.join(plain, ["id", "text_hash"])
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = texts.select("fp", "copies", "root", "own", "text", every).select("fp", "copies", "root", "own", "text", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tasks = paired.repartition(partitions(docs.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    linked = checkpoint(verified(tasks, n, threshold))
    whole = components(linked.filter("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct())
    links = linked.groupBy("fp").agg(F.sum("links").alias("links"))
    joined = reps.select("fp", "rep", "copies").join(links, "fp", "left").join(whole.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = checkpoint(joined)
    firsts = checkpoint(joined.groupBy(F.col("root").alias("of_root")).agg(F.min("rep").alias("first_row"), F.count(F.lit(1)).alias("n")))
    final = spread_join(joined, firsts.drop("n"), "root", "of_root", counts=firsts.select(F.col("of_root").alias("key"), "n"))
    final = checkpoint(final.select(F.col("fp").alias("of_fp"), "first_row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    known = spread_join(found.filter(some).select("id", "text_hash", "fp"), final, "fp", "of_fp", counts=reps.select(F.col("fp").alias("key"), F.col("copies").alias("n")))
    is_first = (F.col("id") == F.col("first_row.id")) & (F.col("text_hash") == F.col("first_row.text_hash"))
    out = known.select("id", "text_hash", is_first.alias("first"), _real(F.col("first_row.id")).alias("class_id"), "n_links")
    return out.union(found.filter(~some).select("id", "text_hash", F.lit(None).cast("boolean"), _real(F.col("id")), F.lit(0).cast("long")))


def _real(value: Column) -> Column:
    return F.when(value != NULL_ID, value)


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """``(doc_id, class_id, n_links)``, a row a row of ``docs``."""
    return rows_in_classes(docs, threshold, n, recall).select(_real(F.col("id")).alias("doc_id"), "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One row of each class, the first by id and text (rows without an id last), and every row without words."""
    kept = rows_in_classes(docs, threshold, n).filter(F.coalesce("first", F.lit(True)))
    kept = checkpoint(kept.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_text")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("first").isNull()).alias("wordless")))
    one = F.col("wordless") | (F.col("n") == 1)
    joined = whole_rows(docs).join(kept, (F.col("id") == F.col("of_id")) & (F.col("text_hash") == F.col("of_text")))
    out = joined.filter(one).select("row.*")
    if kept.filter(~one).limit(1).count():  # rows of equal id and text
        out = out.union(joined.filter(~one).dropDuplicates(["id", "text_hash"]).select("row.*"))
    return out


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
