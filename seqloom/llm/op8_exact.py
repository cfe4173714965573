"""Exact top-k search with an impact-ordered, score-at-a-time index.

Components are quantised to whole numbers, floor(scale * x). A block of vectors is
indexed by postings: for each dimension the vectors in order of impact, cut in
segments of equal quantised impact (a step of ``STEP``). A query's segments of all
dimensions are processed by how little they fall short of the dimension's largest
contribution, so the highest impacts come first. For each vector the sum of
shortfalls seen and their number give an upper bound: no unseen dimension falls
short by less than the next segment does. Vectors with the best bounds are scored
exactly as it goes, which gives a k-th best score; once the bound proves that few
others can reach it, these possible members are scored exactly, too. Nothing else
ends the search, so the result is exact at any point it stops.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part; only vectors of equal dimension are compared; ties go to the smaller
id; fewer candidates than k give all. A query's own row is left out by its id, so
rows that repeat an id are not candidates of each other. A repeated query row is one
query. Scores are 64-bit: components so large that a score might not fit raise an
OverflowError before anything is searched. Sums that prove a bound are in doubles; a
slack larger than their rounding is added, so no proof rests on a rounded digit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, table
from seqloom.llm.vectors import block_count, packed, search, usable

STEP = 16
#: Postings processed between looks at the bounds, as a share of a block's; members scored at a look.
LOOKS, AT_A_LOOK = 12, 32
#: Possible members left to score exactly, as a share of a block, that end the search of it.
FEW = 0.02


def index(blocks: DataFrame, scale: int) -> DataFrame:
    """Adds to packed blocks the quantised components and each dimension's vectors by falling impact."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                whole = np.floor(np.frombuffer(batch.column(3)[i].as_py(), np.float64).reshape(-1, dim) * scale).astype(np.int64)
                order = np.argsort(-whole, axis=0, kind="stable").T.astype(np.int32)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([batch.column(1)[i].as_py()], pa.int32()), "ids": pa.array([batch.column(2)[i].as_py()], pa.binary()), "a": pa.array([whole.tobytes()], pa.binary()), "b": pa.array([order.tobytes()], pa.binary()), "c": pa.array([b""], pa.binary())})

    return blocks.mapInArrow(run, "dim int, block int, ids binary, a binary, b binary, c binary")


class Block:
    def __init__(self, ids: np.ndarray, whole: np.ndarray, order: np.ndarray):
        self.ids, self.whole, self.order = ids, whole, order
        n, dims = whole.shape
        sorted_values = np.take_along_axis(whole.T, order.astype(np.int64), 1)
        level = sorted_values // STEP
        edge = np.ones_like(level, bool)
        edge[:, 1:] = level[:, 1:] != level[:, :-1]
        self.dim, start = np.nonzero(edge)
        self.start = self.dim * n + start
        self.stop = np.r_[self.start[1:], n * dims]
        flat = sorted_values.reshape(-1)
        self.high, self.low = flat[self.start], flat[self.stop - 1]
        self.flat = order.reshape(-1)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best, best first, ties by id."""
        n, dims = self.whole.shape
        top = np.maximum(query[self.dim] * self.high, query[self.dim] * self.low)  # each segment's largest contribution
        most = np.full(dims, -(2**62))
        np.maximum.at(most, self.dim, top)
        short = most[self.dim] - top
        order = np.argsort(short, kind="stable")
        sizes = (self.stop - self.start)[order]
        done = np.cumsum(sizes)
        looks = np.searchsorted(done, np.linspace(0, n * dims, LOOKS + 1)[1:-1], side="right")
        lost, seen = np.zeros(n), np.zeros(n, np.int64)
        candidate = self.ids != own
        exact = np.zeros(n, bool)
        scores = np.full(n, -(2**62))
        bound, at, limit = float(most.sum()), 0, max(4 * k, int(FEW * n))
        bound += (abs(bound) + float(short.max(initial=0)) * dims) * dims * 2.0**-50  # above the rounding of the sums

        def score(which: np.ndarray) -> None:
            scores[which] = self.whole[which] @ query
            exact[which] = True

        def reached() -> float:
            got = scores[exact]
            return float(np.partition(got, len(got) - k)[len(got) - k]) if len(got) >= k else -np.inf

        for look in [*looks.tolist(), len(order)]:
            part = order[at:look]
            if len(part):
                length = sizes[at:look]
                first = np.repeat(self.start[part] - np.r_[0, np.cumsum(length)[:-1]], length)
                docs = self.flat[first + np.arange(len(first))]
                lost += np.bincount(docs, np.repeat(short[part], length), n)
                seen += np.bincount(docs, minlength=n)
            at = look
            rest = float(short[order[at]]) if at < len(order) else 0.0
            upper = np.where(candidate, bound - lost - (dims - seen) * rest, -np.inf)
            hopeful = np.where(exact, -np.inf, upper)
            if np.isneginf(hopeful).all():
                break
            few = np.argpartition(-hopeful, min(AT_A_LOOK, n - 1))[: AT_A_LOOK + 1]
            score(few[np.isfinite(hopeful[few])])
            possible = ~exact & (upper >= reached()) & candidate
            if possible.sum() <= limit or at >= len(order):
                score(np.flatnonzero(possible))
                break
        members = np.flatnonzero(exact)
        chosen = members[np.lexsort((self.ids[members], -scores[members]))][:k]
        return chosen, scores[chosen]


def exact_search(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score long)`` for the rows whose id is divisible by ``every``."""
    vectors = usable(df, id_column, vector_column, zero_too=True)
    n, asked, fits = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.pow(scale * F.array_max(F.transform("v", F.abs)) + 1, 2) * F.col("dim"))).first()
    if (fits or 0) >= 2.0**62:
        raise OverflowError("components too large: scores might not fit 64 bits")
    blocks = block_count(n)
    built = checkpoint(index(packed(vectors, blocks), scale))

    def make():
        def opening(dim: int, ids: bytes, whole: bytes, postings: bytes, _: bytes) -> Block:
            return Block(np.frombuffer(ids, np.int64), np.frombuffer(whole, np.int64).reshape(-1, dim), np.frombuffer(postings, np.int32).reshape(dim, -1))

        def best(block: Block, ids: np.ndarray, q: np.ndarray):
            whole = np.floor(q * scale).astype(np.int64)
            asked, found, scores = [], [], []
            for i, own in enumerate(ids.tolist()):
                where, score = block.best(whole[i], own, k)
                asked.append(np.full(len(where), own))
                found.append(block.ids[where])
                scores.append(score)
            return np.concatenate(asked), np.concatenate(found), np.concatenate(scores)

        return opening, best

    queries = vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    return search(built, blocks, queries, asked, make, k, "long")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), p -> p[1] * p[2])) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
