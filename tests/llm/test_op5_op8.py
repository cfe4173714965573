import numpy as np
import pytest

from seqloom.llm import op5_aq, op8_exact, vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, dim string")


def clean(rows, zero):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]


def brute(rows, every, k, scale=None):
    own, out = clean(rows, scale is not None), []
    if scale:
        own = [(i, np.floor(v * scale).astype(np.int64)) for i, v in own]
    for q, u in own:
        if q % every == 0:
            found = sorted(((-(u * v).sum(), i) for i, v in own if i != q and len(v) == len(u)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def some(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 1 / np.sqrt(dim), dim).tolist()) for i in range(n)]


ODD = [(5000, None), (5100, []), (5200, [1.0, None]), (5300, [float("nan")] * 16), (5400, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (5500, [0.0] * 16), (5600, [1.0, 2.0]), (5601, [1.0, 3.0]), (5700, [0.5] * 16), (5701, [0.5] * 16), (5702, [0.5] * 16)]


@pytest.mark.parametrize("block", [8192, 64])
def test_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = some(400) + ODD
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op8_exact.exact_search(frame(spark, rows)).collect())
    assert got == sorted(brute(rows, 100, 10, 1024))


def test_exact_block_with_ties_and_signs():
    rng = np.random.default_rng(1)
    whole = rng.integers(-40, 40, (300, 5))
    whole[50:90] = whole[3]
    block = op8_exact.Block(np.arange(300), whole, np.argsort(-whole, axis=0, kind="stable").T.astype(np.int32))
    for q in range(0, 300, 7):
        where, scores = block.best(whole[q], q, 10)
        want = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:10]
        assert list(zip((-scores).tolist(), where.tolist(), strict=True)) == want


def test_approximate(spark):
    rows = some(4000, 32, 2) + [(9000 + i, [0.25] * 32) for i in range(60)]
    got = op5_aq.nearest(frame(spark, rows), rerank=0.05).collect()
    want = brute(rows, 20, 20)
    hit = len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want})
    assert len(got) == len(want) and hit >= 0.9 * len(want)
    vectors_of = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for r in got:
        assert abs(r.score - vectors_of[r.query_id] @ vectors_of[r.vec_id]) < 1e-12
    ties = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 9000]
    assert ties == list(range(9001, 9021))


def test_approximate_odd(spark):
    got = sorted((r.query_id, r.rank, r.vec_id) for r in op5_aq.nearest(frame(spark, some(30) + ODD)).collect())
    assert got == sorted(x[:3] for x in brute(some(30) + ODD, 20, 20))
    for search in (op5_aq.nearest, op8_exact.exact_search):
        assert search(frame(spark, [])).collect() == []
        assert search(frame(spark, [(7, [1.0, 2.0])])).collect() == []
        assert search(frame(spark, [(0, [1.0, 2.0])])).collect() == []


def test_beam_is_no_worse_than_greedy():
    x = np.array([v for _, v in some(500, 16, 5)])
    books = op5_aq.train(x, books=4, size=16)
    error = lambda beam: ((x - sum(books[m][c] for m, c in enumerate(op5_aq.beam_encode(x, books, beam).T))) ** 2).sum()
    assert error(8) <= error(1)


def test_driver_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op8_exact.op8_exact(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(brute(rows, 100, 10, 1024))
    near = {(r.query_id, r.vec_id) for r in op5_aq.op5_aq(spark, "/root/testdata/sf0.001").collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 20)}
    assert len(near & want) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [100, 1500])
def test_small_tables_are_searched_by_their_codes(spark, n):
    """Well under all rows are scored exactly, and recall holds."""
    rows = some(n, 32, 9)
    got = {(r.query_id, r.vec_id) for r in op5_aq.nearest(frame(spark, rows), every=5).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 5, 20)}
    assert max(2 * 20, n / 16) + 1 < n / 2 and len(got & want) >= 0.9 * len(want)


def test_dimensions_outside_the_sample_have_books(spark):
    rows = some(900, 16, 3) + [(1000 + i, v) for i, v in some(80, 24, 4)]
    got = {(r.query_id, r.vec_id) for r in op5_aq.nearest(frame(spark, rows), sample=600, k=10).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 10)}
    assert len(got & want) >= 0.9 * len(want)


def test_scores_that_fit_and_scores_that_do_not(spark):
    large = 2.0**18
    rows = [(0, [large] * 16), (1, [-large] * 16), (2, [large] * 15 + [-large]), (3, [1.0] * 16)]
    got = [(r.vec_id, r.score) for r in sorted(op8_exact.exact_search(frame(spark, rows)).collect(), key=lambda r: r.rank)]
    side = 1024 * 2**18
    assert got == [(2, 14 * side**2), (3, 16 * side * 1024), (1, -16 * side**2)]
    with pytest.raises(OverflowError):
        op8_exact.exact_search(frame(spark, [(0, [2.0**21] * 16), (1, [-(2.0**21)] * 16)]))
