import math
import random

from pyspark.sql import functions as F

from seqloom import plans
from seqloom.operators import alignment as L
from seqloom.operators import genomes as G

SF = "/root/testdata/sf0.001"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment(spark):
    rng = random.Random(0)
    made = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for _ in range(40):
        a, b = made(rng.randrange(0, 12)), made(rng.randrange(0, 12))
        assert -L.align(a, b, match=0)[0] == edit(a, b)
        score, same, columns, start, stop = L.align(a, b)
        assert max(len(a), len(b)) <= columns <= len(a) + len(b) and (start, stop) == (0, len(b)) and same <= min(len(a), len(b))
    target = made(50)
    assert L.align(target[10:30], target, "glocal") == (20, 20, 20, 10, 30)
    assert L.align("TTTT" + target[5:25] + "CCCC", target, "local")[1] >= 20
    rows = spark.createDataFrame([("ACGT", "ACGA"), (None, "A"), ("", "")], "q string, t string")
    assert [(r.score, r.identity) for r in L.aligned(rows, "q", "t").collect()] == [(2, 0.75), (None, None), (0, 0.0)]


def test_merge_and_seeds(spark):
    rng = random.Random(1)
    whole = "".join(rng.choice("ACGT") for _ in range(100))
    back = whole[30:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    row = L.merged_mates(spark.createDataFrame([(whole[:60], back), ("ACGTACGTAC", "")], "one string, two string")).collect()
    assert row[0].merged == whole and row[0].overlap == 30 and row[1].merged is None
    refs = spark.createDataFrame([(1, whole), (2, whole[::-1])], "id int, bases string")
    found = L.seed_pairs(spark.createDataFrame([(7, whole[20:60])], "id int, bases string"), refs, 11, 5).collect()
    assert [(r.query_id, r.target_id, r.seeds) for r in found] == [(7, 1, 30)]


def test_correction_and_consensus(spark):
    rng = random.Random(2)
    whole = "".join(rng.choice("ACGT") for _ in range(80))
    wrong = whole[:40] + ("A" if whole[40] != "A" else "C") + whole[41:]
    rows = spark.createDataFrame([(i, whole) for i in range(6)] + [(9, wrong)], "id int, bases string")
    got = {r.id: (r.bases, r.fixed) for r in G.correct_errors(rows, "id", "bases", 15, 3).collect()}
    assert got[9] == (whole, 1) and got[0] == (whole, 0)
    votes = spark.createDataFrame([("x", p, b, w) for p, b, w in [(0, "A", 2), (0, "C", 1), (1, "G", 1), (1, "T", 1)]], "k string, p int, b string, w int")
    assert G.consensus(votes, "k", "p", "b", "w").first()[:] == ("x", "AG", 2)


def test_frames_repeats_variants(spark):
    one = spark.createDataFrame([("c", "CCATGAAATTTTAGCC" + "ACACACAC")], "id string, bases string")
    assert [tuple(r) for r in G.open_frames(one, "id", "bases", 9).collect()] == [("c", "+", 2, 14, 12)]
    assert [tuple(r) for r in G.tandem_repeats(one, "id", "bases", 2, 3).collect()] == [("c", "CA", 1)]
    v = spark.createDataFrame([(5, "CAGT", "CGT"), (5, "A", "T"), (5, "AAA", "AA")], "pos int, ref string, alt string").select(G.normalise_variant(F.col("pos"), F.col("ref"), F.col("alt")).alias("v"))
    assert [tuple(r.v) for r in v.collect()] == [(5, "CA", "C"), (5, "A", "T"), (5, "AA", "A")]
    assert G.split_alleles(spark.createDataFrame([(1, "A,C")], "pos int, alt string")).count() == 2
    calls = spark.createDataFrame([("c", 3, "ATG", "A", 9), ("c", 4, "T", "C", 5), ("c", 15, "C", "GG", 7)], "id string, pos int, ref string, alt string, depth long")
    assert G.apply_variants(one, calls, "id", "bases").first()[:] == ("c", "CCAAAATTTTAGGGC" + "ACACACAC", 2)


def test_made_up_and_network(spark):
    reads = G.synthetic_reads(spark, 50, 40, 1)
    assert reads.exceptAll(G.synthetic_reads(spark, 50, 40, 1).repartition(3)).isEmpty() and reads.filter("length(bases) <> 40").isEmpty()
    share = G.mutate(reads, "bases", 0.2).join(reads.withColumnRenamed("bases", "b"), "id").select(F.sum(F.aggregate(F.zip_with(F.split("bases", ""), F.split("b", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x))).first()[0] / 2000
    assert 0.15 < share < 0.25
    row = spark.createDataFrame([([1.0, 2.0],)], "x array<double>").select(G.network(F.col("x"), [([[0.5, -0.25], [1.0, 1.0]], [0.1, 0.0]), ([[2.0, -1.0]], [0.5])])).first()[0]
    h = [math.tanh(0.1), math.tanh(3.0)]
    assert abs(row[0] - 1 / (1 + math.exp(-(2 * h[0] - h[1] + 0.5)))) < 1e-12


def letters(text):
    return "".join(c for c in text.upper() if c in "ACGTN")


def test_whole_mates_and_alleles(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]
    want = {}
    for i, text in rows:
        b = letters(text)
        one, two = b[: len(b) // 2], b[len(b) // 3 :]
        n = L.best_overlap(one, two) if one and two else 0
        want[i] = (n, len(one) + len(two) - n if n else None)
    assert {r.id: (r.overlap, r.length) for r in plans.QUERIES["merge_mates"](spark, SF).collect()} == want
    alleles = sorted((i, k, a) for i, text in rows for k, a in enumerate(text.split(","), 1))
    assert sorted(map(tuple, plans.QUERIES["split_alleles"](spark, SF).collect())) == alleles
