"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each codebook.
Codebooks are trained on a bounded sample: k-means on the residuals of the books
before, then rounds of beam-search encoding and a joint least-squares update of all
codewords. Encoding is a beam search: of the partial sums the ``beam`` nearest to
the vector go on to the next book. With the codes a scale factor, the stored norm of
the vector over that of its sum, is kept. A query's inner products with all
codewords are looked up and summed for each code, which ranks each block's vectors;
the best of a block, a share ``rerank`` of its vectors but ``2 * k`` at least, are
scored exactly in doubles (ties by id). So their number grows with the rows, recall
doesn't fall as the table grows, and every table, small or large, is searched by its
codes. Every row is indexed.

Books are trained for each dimension, on the ``sample`` vectors of the table with the
least hashes; a block of a dimension with fewer than ``size`` of these trains books on
its own first ``sample`` vectors instead, so all dimensions are coded.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; only vectors of equal dimension are compared; ties go to
the smaller id; fewer candidates than k give all. A query's own row is left out by
its id; rows that repeat an id aren't candidates of each other. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, table
from seqloom.llm.vectors import block_count, packed, search, usable


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None] - 2 * x @ centres.T


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of each row, int64 of shape (rows, books)."""
    n, (m, k, _) = len(x), books.shape
    residual = x[:, None, :]
    codes = np.zeros((n, 1, 0), np.int64)
    for book in books:
        width = residual.shape[1]
        cost = (residual**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * residual @ book.T
        cost = cost.reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(width * k), (n, 1))
        rows = np.arange(n)[:, None]
        from_, code = best // k, best % k
        residual = residual[rows, from_] - book[code]
        codes = np.concatenate([codes[rows, from_], code[:, :, None]], 2)
    return codes[np.arange(n), (residual**2).sum(2).argmin(1)]


def train(x: np.ndarray, books: int = 12, size: int = 256, beam: int = 4, rounds: int = 1, seed: int = 3) -> np.ndarray:
    """Codebooks of shape (books, size, dimension)."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    out, residual = [], x.copy()
    for _ in range(books):
        centres = residual[rng.permutation(len(x))[:size]].copy()
        for _ in range(6):
            code = _nearest(residual, centres).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, code, residual)
            count = np.bincount(code, minlength=size)
            centres[count > 0] = sums[count > 0] / count[count > 0, None]
        residual = residual - centres[_nearest(residual, centres).argmin(1)]
        out.append(centres)
    result = np.stack(out)
    for _ in range(rounds):
        codes = np.concatenate([beam_encode(x[a : a + 512], result, beam) for a in range(0, len(x), 512)]) + np.arange(books) * size
        total = books * size
        gram = np.zeros((total, total))
        right = np.zeros((total, x.shape[1]))
        for a in range(books):
            np.add.at(right, codes[:, a], x)
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1.0)
        gram[np.diag_indices(total)] += 1e-2
        prior = result.reshape(total, -1)
        result = np.linalg.solve(gram, right + 1e-2 * prior).reshape(result.shape)
    return result


def trained(sample: DataFrame, books: int, size: int, beam: int) -> dict[int, np.ndarray]:
    """Books of each dimension with at least ``size`` rows of ``sample(dim, v)``, trained in tasks; they are of a fixed size, whatever the data."""
    schema = pa.schema([("dim", pa.int32()), ("size", pa.int32()), ("made", pa.binary())])

    def fit(rows: pa.Table) -> pa.Table:
        if rows.num_rows < size:
            return schema.empty_table()
        x = np.array(rows["v"].to_pylist())
        made = train(x, books, size, beam).astype(np.float32)
        return pa.table([[x.shape[1]], [made.shape[1]], [made.tobytes()]], schema=schema)

    found = sample.groupBy("dim").applyInArrow(fit, "dim int, size int, made binary").collect()
    return {r.dim: np.frombuffer(r.made, np.float32).reshape(books, r.size, r.dim) for r in found}


def encode(blocks: DataFrame, known: dict[int, np.ndarray], sample: int, books: int, size: int, beam: int) -> DataFrame:
    """``(dim, block, ids, a, b, c)`` of packed blocks: vectors, codes with scale factors, and books where the block has its own."""
    shared = blocks.sparkSession.sparkContext.broadcast(known)  # books of the sample's dimensions: a fixed size each

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, block, ids, vecs = (batch.column(c)[i].as_py() for c in range(4))
                x = np.frombuffer(vecs, np.float64).reshape(-1, dim)
                own, extra = shared.value.get(dim), b""
                if own is None:
                    own = train(x[:sample], books, size, beam).astype(np.float32)
                    extra = own.tobytes()
                code = np.concatenate([beam_encode(x[a : a + 1024].astype(np.float32), own, beam) for a in range(0, len(x), 1024)])
                sums = sum(own[m][code[:, m]] for m in range(len(own)))
                norm = np.sqrt((x**2).sum(1)) / np.maximum(np.sqrt((sums.astype(np.float64) ** 2).sum(1)), 1e-30)
                coded = code.astype(np.uint8).tobytes() + norm.astype(np.float32).tobytes()
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "ids": pa.array([ids], pa.binary()), "a": pa.array([vecs], pa.binary()), "b": pa.array([coded], pa.binary()), "c": pa.array([extra], pa.binary())})

    return blocks.mapInArrow(run, "dim int, block int, ids binary, a binary, b binary, c binary")


class Block:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, coded: bytes, extra: bytes, known: dict[int, np.ndarray], n_books: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        n = len(self.ids)
        self.codes = np.frombuffer(coded, np.uint8, n * n_books).reshape(n, n_books)
        self.scale = np.frombuffer(coded, np.float32, offset=n * n_books)
        self.books = np.frombuffer(extra, np.float32).reshape(n_books, -1, dim) if extra else known[dim]

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: float):
        """(query id, vector id, score) of each query's k best among those the codes rank first."""
        n = len(self.ids)
        taken = min(n, max(2 * k, int(np.ceil(rerank * n))) + 1)  # one more, for the query's own row
        looked = np.zeros((n, len(q)), np.float32)
        for m, book in enumerate(self.books):
            looked += (book @ q.T.astype(np.float32))[self.codes[:, m]]
        looked *= self.scale[:, None]
        looked = np.ascontiguousarray(looked.T)
        cuts = np.partition(looked, n - taken, axis=1)[:, n - taken]
        asked, found, scores = [], [], []
        for i, own in enumerate(q_ids.tolist()):
            above = np.flatnonzero(looked[i] > cuts[i])
            ties = np.flatnonzero(looked[i] == cuts[i])[: taken - len(above)]  # the smallest ids
            where = np.concatenate([above, ties])
            where = where[self.ids[where] != own]
            score = (self.x[where] * q[i]).sum(1)
            top = np.lexsort((self.ids[where], -score))[:k]
            asked.append(np.full(len(top), own))
            found.append(self.ids[where][top])
            scores.append(score[top])
        return np.concatenate(asked), np.concatenate(found), np.concatenate(scores)


def nearest(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20, sample: int = 8192, books: int = 12, size: int = 256, beam: int = 4, rerank: float = 1 / 16) -> DataFrame:
    """``(query_id, rank, vec_id, score double)`` for the rows whose id is divisible by ``every``; books are trained on at most ``sample`` vectors."""
    vectors = usable(df, id_column, vector_column, zero_too=False)
    n, asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "v")
    known = trained(chosen, books, size, beam)
    blocks = block_count(n)
    index = checkpoint(encode(packed(vectors, blocks), known, sample, books, size, beam))
    shared = df.sparkSession.sparkContext.broadcast(known)

    def make():
        return lambda *row: Block(*row, shared.value, books), lambda block, ids, q: block.best(ids, q, k, rerank)

    queries = vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    return search(index, blocks, queries, asked, make, k, "double")


def op5_aq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
