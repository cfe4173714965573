import random

import pytest

from seqloom.llm import op10_repeats as op
from tests_llm_util import words


def brute(rows, least):
    seen, flagged = {}, {}
    for doc, text in sorted(rows):
        w = (text or "").split()
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            if key in seen:
                flagged.setdefault(doc, set()).update(range(s, s + least))
            else:
                seen[key] = doc
    return flagged


def covered(rows):
    out = {}
    for doc, _, start, end in rows:
        out.setdefault(doc, set()).update(range(start, end))
    return out


@pytest.mark.parametrize("least", [50, 12])
def test_against_brute_force(spark, docs, least):
    rng = random.Random(least)
    shared = [words(rng, k) for k in (least - 1, least, least + 1, least + 40, 3 * least)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), words(rng, rng.randrange(0, 40))]
        texts.append("\n".join(parts))
    base = words(rng, 4 * least).split()
    for _ in range(25):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, shared[2], shared[2], (words(rng, 7) + " ") * 40]
    rows = list(enumerate(texts))
    assert covered(map(tuple, op.passages(docs(texts), least).collect())) == brute(rows, least)


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op.op10_repeats(spark, "/root/testdata/sf0.001").collect()
    assert covered((r.doc_id, r.first_id, r.start, r.end) for r in got) == brute(rows, 50)
    assert all(r.first_id <= r.doc_id and r.n_words >= 50 for r in got)


def test_one_key_over_many_partitions(spark, docs):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rng = random.Random(1)
        passage = words(rng, 60)
        texts = [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(300)]
        assert covered(map(tuple, op.passages(docs(texts)).collect())) == brute(list(enumerate(texts)), 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_removal(spark, docs):
    rng = random.Random(2)
    passage, own = words(rng, 70), words(rng, 20)
    made = docs([(1, passage, "a"), (2, f"{own} {passage}\n{own}", "a"), (3, passage, "b"), (4, "short", None), (5, None, None), (None, own, None)])
    out = {r.doc_id: r for r in op.remove_repeats(made).collect()}
    assert set(out) == {1, 2, 4, 5, None}
    assert out[1].text == passage and out[2].text == f"{own} {own}" and out[2].n_chars == len(out[2].text)
    assert out[4].text == "short" and out[5].text is None
    assert op.remove_repeats(made).columns == made.columns


def test_repeated_ids_and_empty(spark, docs):
    rng = random.Random(6)
    text = words(rng, 80)
    assert op.passages(docs([(1, text, "a"), (1, text, "a")])).collect() == []
    assert op.passages(docs([])).collect() == []
    assert op.remove_repeats(docs([])).collect() == []


def test_rows_without_ids_are_texts_of_their_own(spark, docs):
    rng = random.Random(8)
    passage, tail = words(rng, 60), words(rng, 300)
    # Equal passages at the same place, null ids; one text is much shorter than the repeat in the other.
    made = docs([(None, passage, "a"), (None, f"{passage} {tail}", "a"), (7, f"{tail} {words(rng, 3)}", "a"), (7, words(rng, 5), "b")])
    got = op.passages(made).collect()
    assert sum(r.end - r.start for r in got) == 60 + 300
    left = [r.text.split() for r in op.remove_repeats(made).collect()]
    assert sum(map(len, left)) == 60 + 300 + 3 + 5


def test_texts_of_one_id(spark, docs):
    rng = random.Random(9)
    passage = words(rng, 60)
    made = docs([(1, f"{passage} one", "a"), (1, f"{passage} two more", "a")])
    assert [(r.doc_id, r.first_id, r.start, r.end) for r in op.passages(made).collect()] == [(1, 1, 0, 60)]
    assert sorted(len(r.text.split()) for r in op.remove_repeats(made).collect()) in ([1, 62], [2, 61])


def test_removal_on_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    flagged = brute(rows, 50)
    want = {i: [w for k, w in enumerate((t or "").split()) if k not in flagged.get(i, ())] for i, t in rows}
    got = {r.doc_id: (r.text or "").split() for r in op.remove_repeats(docs).collect()}
    assert got == {i: w for i, w in want.items() if w or i not in flagged}


def test_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    passage = words(rng, 60)
    made = docs([(1, passage, "a"), (2, f"{passage} tail", "a")])
    for name in ("_id", "spans", "row", "id", "text_hash", "of_id", "key", "low"):
        made = made.withColumn(name, F.lit("z"))
    got = sorted(op.remove_repeats(made).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == [passage, "tail"] and got[1]["_id"] == got[1]["spans"] == "z" and op.remove_repeats(made).columns == made.columns
