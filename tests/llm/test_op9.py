import itertools
import math
import random
import re
import zlib

import numpy as np

from seqloom.llm import op9_toxicity as op
from tests_llm_util import words

INSULTS = ["blorgface", "snivelwit", "grubnose"]


def corpus(rng, n=500):
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(5, 60)).split()
        toxic = int(i % 5 == 0)
        for _ in range(toxic * rng.randrange(1, 4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(INSULTS))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_gapped_and_inserted(spark, docs):
    rng = random.Random(8)
    rows, labels = corpus(rng)
    known = spark.createDataFrame([*labels, (99999, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = op.fit(docs(rows), known)
    got = {r.doc_id: r.score for r in op.score(docs(rows), model).collect()}
    held = [(got[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((s >= 0.5) == t for s, t in held) and all(0 <= s <= 1 for s in got.values())
    clean = words(rng, 30)
    odd = [f"{clean} {x} {clean}" for x in ("blorg-face", "BLORGFACE", "s n i v e l w i t", "blor.gf.ace", "blorxgface", "snivelqwit", "grubnosey")]
    more = {r.doc_id: r.score for r in op.score(docs([*odd, clean, "", None, "...", "x" * 5000]), model).collect()}
    assert all(more[i] >= 0.5 for i in range(len(odd)))
    assert more[len(odd)] < 0.5 and more[len(odd) + 1] == more[len(odd) + 2] == more[len(odd) + 3] == 0.0 and more[len(odd) + 4] < 0.5


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.fit(docs(["a b"]), none) is None
    assert [r.score for r in op.score(docs(["a b", None]), None).collect()] == [0.0, 0.0]
    assert op.score(docs([]), None).collect() == []


SPAN, DECAY = 5, 0.6


def plain_windows(text):
    """Words and neighbouring pairs of a text's sentences, with blanks around, by plain string functions."""
    out = []
    for sentence in re.split(r"\n|(?<=[.!?])\s", text.lower()):
        words = [w for w in ("".join(c for c in x if c.isalnum()) for x in sentence.split()) if w]
        joined = []
        for single, run in itertools.groupby(words, lambda w: len(w) == 1 and w.isalpha()):
            run = list(run)
            joined += ["".join(run)] if single and len(run) > 2 else run
        out += [f" {w} " for w in joined] + [f" {a} {b} " for a, b in itertools.pairwise(joined)]
    return out


def plain_features(window):
    """Weights of the subsequences of two and three characters within the span, scaled as the kernel is."""
    symbol = [28 if c == " " else ord(c) - 96 for c in window]
    out, square = {}, 0.0
    for size in (2, 3):
        for at in itertools.combinations(range(len(symbol)), size):
            if at[-1] - at[0] < SPAN:
                code = symbol[at[0]] * 64 + symbol[at[1]]
                code = code if size == 2 else 64 * 64 + code * 64 + symbol[at[2]]
                weight = DECAY ** (at[-1] - at[0] + 1)
                out[code] = out.get(code, 0.0) + weight
                square += weight * weight
    return {c: w / math.sqrt(square) for c, w in out.items()}


def test_scores_equal_the_plain_kernel_sum():
    """Values by running sums over whole texts are the kernel sums with each landmark, window by window."""
    rng = random.Random(4)
    landmarks = [" idiot ", " stone age ", " idol ", " tin "]
    coefficients = [1.0, -0.5, 0.25, 0.125]
    codes = [bytes(28 if c == " " else ord(c) - 96 for c in x) for x in landmarks]
    features, used = op.dense(op.matrix(codes))
    weights = np.zeros(op.CODES)
    weights[used] = np.array(coefficients) @ features
    texts = ["You idxiot. Stone", "i d i o t", "a b", "x", "", "... !", "Tin stone age\nidol id-iot", words(rng, 60)]
    got = op.worst_values(texts, weights, 0.25)
    for text, value in zip(texts, got, strict=True):
        own = [plain_features(w) for w in plain_windows(text)]
        marks = [plain_features(x) for x in landmarks]
        sums = [sum(c * sum(w * f.get(k, 0.0) for k, w in m.items()) for c, m in zip(coefficients, marks, strict=True)) + 0.25 for f in own]
        assert abs(value - max(sums, default=op.FLOOR)) < 1e-9
    s = op.matrix(codes)
    assert np.allclose(op.kernel_rows(s, features, used), features @ features.T)


def test_two_ordinary_words_together(spark, docs):
    """Neither word is toxic by itself; both together are."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(700):
        w = words(rng, rng.randrange(8, 30)).split()
        toxic, at = int(i % 4 == 0), rng.randrange(len(w))
        if toxic:
            w[at:at] = ["eat", "dirt"]
        elif i % 4 == 1:
            w.insert(at, rng.choice(["eat", "dirt"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, toxic))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in op.score(docs(rows), op.fit(docs(rows), known)).collect()}
    held = [(got[i] >= 0.5) == t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) >= 0.97 * len(held)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(13)
    weights = np.random.default_rng(1).normal(size=op.CODES)
    texts = [words(rng, 3000), "short one", "x" * 5000, words(rng, 700), ""]
    whole = op.worst_values(texts, weights, 0.0)
    monkeypatch.setattr(op, "PIECE", 1500)
    pieces = op.worst_values(texts, weights, 0.0)
    assert np.allclose(pieces[[0, 1, 3, 4]], whole[[0, 1, 3, 4]]) and abs(pieces[2] - whole[2]) < 1e-9


def test_repeated_rows_and_ids(spark, docs):
    rng = random.Random(5)
    rows, labels = corpus(rng, 200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = docs(rows + rows[:20] * 5 + [(None, rows[0][1], "s")] * 3)
    got = op.score(made, op.fit(made, known)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(got) == 200 + 100 + 3 and all(len(v) == 1 for v in by_id.values())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, toxic[r.doc_id]) for r in op.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    found = sum(p for p, t in got if t) / sum(t for _, t in got)
    alone = sum(1 - p for p, t in got if not t) / sum(1 - t for _, t in got)
    assert found >= 0.8 and alone >= 0.98, (found, alone)


def test_query(spark):
    got = op.op9_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
