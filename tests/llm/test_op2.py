import random
import time

from pyspark.sql import functions as F

from seqloom.llm import common
from seqloom.llm import op2_jaccard as op
from tests_llm_util import words


def brute(rows, threshold=0.8, n=5):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    near = [[a != b and bool(s) and bool(t) and len(s & t) >= threshold * len(s | t) for b, t in enumerate(sets)] for a, s in enumerate(sets)]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if near[a][b] and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, []).append(rows[i][0])
    return sorted((rows[i][0], min(least[root[i]]), sum(near[i])) for i in range(len(rows)))


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(3, 120)) for _ in range(30)]
    for k in (100, 200, 400):
        base = words(rng, k)
        texts += near_copies(rng, base, 12, k // 100) + [base, base, base.upper()]
    texts += ["", " \n", None, "one two", "One  two", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    got = sorted(map(tuple, op.classes(docs(texts)).collect()))
    assert got == brute(rows)


def test_split_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 5)
    rng = random.Random(4)
    texts = near_copies(rng, words(rng, 150), 40, 2) + [words(rng, 50)]
    got = sorted(map(tuple, op.classes(docs(texts)).collect()))
    assert got == brute(list(enumerate(texts)))


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, op.op2_jaccard(spark, "/root/testdata/sf0.001").collect()))
    assert got == brute(rows)


def test_null_and_repeated_ids(spark, docs):
    got = sorted(map(tuple, op.classes(docs([(None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (5, "a b c d e f", None), (7, "x", None), (None, "", None)])).collect()), key=str)
    assert got == sorted([(None, 5, 2), (5, 5, 2), (5, 5, 2), (7, 7, 0), (None, None, 0)], key=str)
    kept = op.keep_one(docs([(None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (5, "a b c d e f", None), (7, "x", None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7]


def test_empty(spark, docs):
    assert op.classes(docs([])).collect() == []
    assert op.keep_one(docs([])).collect() == []


def test_bands_reach_recall():
    bands, rows = op.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_many_rows_without_ids(spark, docs):
    """Work grows with the rows, not with their square, though all ids are the same."""
    rng = random.Random(9)
    rows = [(None, words(rng, 9), "s") for _ in range(6000)] + [(None, "a b c d e f g", "s")] * 500 + [(3, "a b c d e f g", "s"), (3, "A b c d e f g", "s"), (3, "other words of this id", "s")]
    made = docs(rows).repartition(4)
    began = time.time()
    got = op.classes(made).collect()
    assert time.time() - began < 120 and len(got) == len(rows)
    kept = op.keep_one(made).collect()
    assert sum(r.doc_id == 3 for r in kept) == 2 and sum(r.text.lower() == "a b c d e f g" for r in kept) == 1
    assert len(kept) == len({t.lower() for _, t, _ in rows})


def test_clashing_columns(spark, docs):
    made = docs([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "", "s"), (3, "", "s"), (4, None, None)])
    for name in ("_kept", "row", "id", "text_hash", "of_id", "n", "first", "wordless", "class_id", "rep", "root"):
        made = made.withColumn(name, F.lit("z"))
    got = op.keep_one(made).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 3, 4] and op.keep_one(made).columns == made.columns and got[0]["root"] == "z"


def test_hot_keys_are_spread(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(14)
    texts = near_copies(rng, words(rng, 150), 30, 2) + [words(rng, 50)] * 40 + [words(rng, 30) for _ in range(20)]
    assert sorted(map(tuple, op.classes(docs(texts)).collect())) == brute(list(enumerate(texts)))
