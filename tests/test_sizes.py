"""Steps that long texts, equal rows and large tables strain, against plain Python."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import composites as C
from seqloom.operators import counting, packed
from seqloom.operators import genomes as G
from seqloom.operators import kmers as K
from seqloom.operators import sets as T

TURN = str.maketrans(S.SYMBOLS, S.COMPLEMENTS)


def back(text):
    return text[::-1].translate(TURN)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    made = [(i, "".join(rng.choice("ACGTN" if i % 3 else "ACGT") for _ in range(rng.randrange(0, 400)))) for i in range(40)]
    return [*made, (40, ""), (41, "AC"), (42, "ACGéèCGTATG\U0001f600AAATAA"), (43, "SWacGTACgtWS")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, bases string")


def test_frames_codons_and_palindromes_of_odd_reads(spark, odd):
    want = set()
    for i, text in odd:
        for strand, b in (("+", text), ("-", back(text))):
            for f in range(3):
                start = None
                for p in range(f, len(b) - 2, 3):
                    if b[p : p + 3] == "ATG" and start is None:
                        start = p
                    if b[p : p + 3] in ("TAA", "TAG", "TGA"):
                        if start is not None and p + 3 - start >= 9:
                            want.add((i, strand, start, p + 3, p + 3 - start))
                        start = None
    assert sorted(map(tuple, G.open_frames(frame(spark, odd), "id", "bases", 9).collect())) == sorted(want)
    turned = sorted((i, p) for i, t in odd for p in range(len(t) - 5) if t[p : p + 6] == back(t[p : p + 6]) and "N" not in t[p : p + 6])
    assert sorted(map(tuple, G.palindromes(frame(spark, odd), "id", "bases", 6).collect())) == turned
    code = dict(zip(S._CODONS, S.CODE, strict=True))
    amino = {(i, f): "".join(code.get(b[p : p + 3], "X") for p in range(f % 3, len(b) - 2, 3)) for i, t in odd for f in range(6) for b in ((t if f < 3 else back(t)),)}
    assert {(r.id, r.frame): r.amino for r in G.six_frames(frame(spark, odd), "id", "bases").collect()} == amino
    assert {(r.id, r.f.frame): r.f.amino for r in frame(spark, odd).select("id", F.explode(S.six_frames(F.col("bases"))).alias("f")).collect()} == amino
    number = lambda w: sum(G._LETTERS.index(c) * len(G._LETTERS) ** j for j, c in enumerate(reversed(w)))
    found = {(i, number(a[p : p + 3])) for (i, f), a in amino.items() for p in range(len(a) - 2) if "X" not in a[p : p + 3]}
    assert sorted(map(tuple, G.protein_words(frame(spark, odd), "id", "bases", 3).collect())) == sorted(found)


def test_kmers_across_pieces(spark, odd):
    for k, step in ((1, 1), (9, 1), (21, 2), (200, 1)):
        got = {r.id: r.k for r in frame(spark, odd).select("id", S.kmers(F.col("bases"), k, step).alias("k")).collect()}
        assert got == {i: [t[p : p + k] for p in range(0, len(t) - k + 1, step)] for i, t in odd}


def test_long_reads_take_time_in_proportion(spark):
    rng = random.Random(6)
    long = frame(spark, [(0, "".join(rng.choice("ACGT") for _ in range(400_000)))]).cache()
    long.count()
    begun = time.time()
    assert G.palindromes(long, "id", "bases", 8).count() and G.open_frames(long, "id", "bases", 60).count()
    assert C.frame_counts(long, "bases", 3).count() == 192 and G.six_frames(long, "id", "bases").count() == 6
    primers = spark.createDataFrame([(1, long.first().bases[300_000:300_012])], "primer int, sequence string")
    assert C.primer_hits(long, primers, "id", "bases").first().distance == 0
    assert time.time() - begun < 60


def test_batches_are_cut_by_symbols():
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "bases": ["ACGT" * 25, None, "A" * 700, "", "C"] * 10})
    parts = list(packed.pieces(batch, 1, 500))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 500 for p in parts)


def test_corrections_with_copies_and_repeated_ids(spark):
    rng = random.Random(8)
    whole = "".join(rng.choice("ACGTN") for _ in range(120))
    other = {"A": "C", "C": "G", "G": "T", "T": "A", "N": "A"}
    at = [i for i in (50, 60, 70) if whole[i] != "N"][0]
    wrong = whole[:at] + other[whole[at]] + whole[at + 1 :]
    rows = [(1, whole)] * 3 + [(9, wrong), (9, wrong), (2, None)]
    got = sorted((r.id, r.bases or "", r.fixed) for r in G.correct_errors(frame(spark, rows), "id", "bases", 15, 3).collect())
    assert got == sorted([(1, whole, 0)] * 3 + [(9, whole, 1)] * 2 + [(2, "", 0)])


def test_pairs_of_equal_rows_are_scored_once(spark):
    rng = random.Random(9)
    rows = [(i if i % 7 else None, rng.choice("xy"), rng.choice(["ab", "abc", "b", None])) for i in range(90)]
    classes = T.class_pairs(spark.createDataFrame(rows, "id long, k string, v string"), "id", ["k"], {"v": ("x", "y")}, block=4)
    got = sorted((r.a, r.b, r.x or "", r.y or "") for r in T.paired(classes, "x", "y").collect())
    assert got == sorted((a[0], b[0], a[2] or "", b[2] or "") for a in rows for b in rows if a[0] and b[0] and a[1] == b[1] and a[0] < b[0])
    assert classes.select("x", "y").distinct().count() == 16


def test_containments_and_clusters_of_copies(spark):
    rng = random.Random(10)
    base = [sorted(rng.sample(range(-40, 40), rng.randrange(1, 30))) for _ in range(12)]
    sets = {i: (base[i % 12] if i % 3 else sorted(set(base[i % 12]) ^ {rng.randrange(-40, 40)})) for i in range(60)} | {60: [], 61: []}
    rank = {i: rng.randrange(8) for i in sets}
    rows = spark.createDataFrame([(i, s, rank[i]) for i, s in sets.items()], "id long, runs array<long>, rank int")
    want = {(a, b): len(set(x) & set(y)) / len(x) for a, x in sets.items() for b, y in sets.items() if a != b and x and len(set(x) & set(y)) / len(x) >= 0.7}
    got = C.containments(rows, "id", "runs", 0.7).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.share for r in got} == want
    centers, placed = [], {}
    for i in sorted(sets, key=lambda x: (rank[x], x)):
        first = next((c for c in centers if (c, i) in want or (i, c) in want), None)
        placed[i] = i if first is None else first
        centers += [i] if first is None else []
    assert {r.id: r.center for r in C.set_clusters(rows, "id", "runs", "rank", 0.7).collect()} == placed


def test_shared_lines_and_widespread_by_hashes(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c", None]), [rng.choice("pqrstuv") for _ in range(3)]) for _ in range(30)] + [("d", None)]
    frame_ = spark.createDataFrame(rows, "g string, w array<string>")
    held = {}
    for g, w in rows:
        for x in w or []:
            held.setdefault(x, set()).add(g)
    got = {r.kmer: r.groups for r in K.widespread(frame_, "g", F.col("w"), 2).collect()}
    assert got == {x: len(s - {None}) for x, s in held.items() if len(s - {None}) >= 2}
    lines = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", None), ("c", None), (None, "x"), ("c", "x"), ("c", "x"), ("a", "y"), ("b", "y")], "g string, l string")
    assert sorted(map(tuple, T.shared_counts(lines, "g", "l").collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    words = spark.createDataFrame([(x,) for x in "aaabbc"] + [(None,)] * 5, "w string")
    assert sorted(map(tuple, counting.prefiltered_counts(words, "w", 2).collect())) == [("a", 3), ("b", 2)]
