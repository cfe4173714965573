from collections import defaultdict

from pyspark.sql import functions as F

from seqloom.llm import op4_mix as op


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share by weight and reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(out.values())
        want = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if want[s] >= most * sizes[s]]
        if not above:
            return out | want
        for s in above:
            out[s] = most * sizes[s]
            open_.discard(s)
    return out



def test_targets_and_taken(spark, docs):
    rows = [(i, " ".join(["w"] * (i * 7 % 90)), ["a", "b", "c", "d", None, "Z"][min(5, i * i % 11)]) for i in range(1500)]
    source = {i: s for i, _, s in rows}
    size = {i: len(t.split()) for i, t, _ in rows}
    sizes = defaultdict(int)
    for i in source:
        sizes[source[i]] += size[i]
    want = targets(dict(sizes))
    got = op.mix(docs(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(source)
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) < 90
    again = op.mix(docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark, docs):
    assert op.mix(docs([])).collect() == []
    got = op.mix(docs([(1, None, None), (1, "", None), (2, "a b", "x"), (2, "a b", "x"), (None, "  c", "x"), (9, " \t", "void")])).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted([("1", 0), ("1", 0), ("2", 2), ("2", 2), ("None", 2), ("9", 0)])
    assert all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    assert {r.target for r in got if r.source_size == 0} == {0.0}


def test_no_python_on_the_main_path(spark, docs):
    plan = op.mix(docs([(1, "a b c", "x"), (2, "d", "y")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_repeated_rows_get_their_own_copies(spark, docs):
    rows = [(None, "a b c", "x")] * 5000 + [(7, "d e", "x"), (7, "f g", "x"), (7, "f g", "y")] + [(i, "w " * (i % 50 + 1), "y") for i in range(100, 400)] + [(None, None, "x")] * 2
    made = docs(rows)
    got = op.mix(made).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    want = targets({"x": 15004, "y": 2 + sum(i % 50 + 1 for i in range(100, 400))})
    for source, size in (("x", 15004), ("y", None)):
        taken = sum(r.taken for r in got if (r.source_size == 15004) == (source == "x"))
        assert abs(taken - want[source]) < 60
    out = op.take(made).collect()
    assert abs(sum(len(r.text.split()) for r in out if r.source == "x" and r.text) - want["x"]) < 60
    assert sum(r.text is None for r in out) == 2


def test_take_with_clashing_columns(spark, docs):
    made = docs([(1, "a b c", "x"), (1, "d", "x"), (None, "e f", "y"), (None, "g", None)])
    for name in ("_id", "_copies", "row", "id", "key", "of_id", "of_key", "rows", "copies", "place", "place_part"):
        made = made.withColumn(name, F.lit("z"))
    out = op.take(made)
    assert out.columns == made.columns and all(r["place"] == "z" for r in out.collect())


def test_many_sources(spark, docs):
    rows = [(i, "w " * (i % 7 + 1), f"host{i % 900:04d}" if i % 10 else None) for i in range(3000)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(dict(sizes))
    got = {r.doc_id: r.target for r in op.mix(docs(rows)).collect()}
    assert all(abs(got[i] - want[s]) < 1e-6 * max(1, want[s]) for i, _, s in rows)
