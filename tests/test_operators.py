"""Operators that SQL can't check, against plain Python."""

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seqloom import plans
from seqloom.functions import scalars as X
from seqloom.functions import sequence as S
from seqloom.operators import graphs as G
from seqloom.operators import kmers as K
from seqloom.operators import rows as R
from seqloom.operators import sets as T

SF = "/root/testdata/sf0.001"
CODONS = {a + b + c: S.CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def test_optimal_trim(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(n)), [rng.choice([0, 2, 7, 9, 11, 13, 25, 40]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 30, 60, 90])]
    got = {r.id: (len(r.bases), r.quals) for r in R.quality_trim(spark.createDataFrame(rows, "id int, bases string, quals array<int>"), "optimal", 10.0).collect()}
    for i, _, q in rows:
        gain = [0.1 - (0.75 if x < 1 else 10 ** (-x / 10)) for x in q]
        best = max(((sum(gain[a:b]), b - a, -a) for a in range(len(q)) for b in range(a + 1, len(q) + 1)), default=(0, 0, 0))
        want = best[1] if best[0] > 1e-12 else 0
        assert got[i][0] == want and len(got[i][1]) == want


def test_six_frames(spark):
    rows = [(1, "ATGGCCTAANGT"), (2, "AC"), (3, "")]
    got = {(r.id, r.frame): r.amino for r in spark.createDataFrame(rows, "id int, bases string").select("id", F.explode(S.six_frames(F.col("bases"))).alias("f")).select("id", "f.*").collect()}
    for i, b in rows:
        back = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for frame in range(6):
            s = (b if frame < 3 else back)[frame % 3 :]
            assert got[i, frame] == "".join(CODONS.get(s[j : j + 3], "X") for j in range(0, len(s) - 2, 3))


def unitigs(counts, k):
    after, before = defaultdict(list), defaultdict(list)
    for x in counts:
        for c in "ACGT":
            if (y := x[1:] + c) in counts and y != x:
                after[x].append(y), before[y].append(x)
    loops = {x for x in counts if x[1:] + x[-1] == x}
    ok = lambda a, b: len(after[a]) == 1 and len(before[b]) == 1 and not {a, b} & loops
    nxt = {x: after[x][0] for x in counts if after[x] and ok(x, after[x][0])}
    heads = set(counts) - set(nxt.values())
    out, seen = [], set()
    for h in sorted(heads) + sorted(counts):
        if h in seen:
            continue
        path = [h]
        seen.add(h)
        while path[-1] in nxt and nxt[path[-1]] not in seen:
            path.append(nxt[path[-1]])
            seen.add(path[-1])
        out.append(path[0] + "".join(p[-1] for p in path[1:]))
    return sorted(out)


@pytest.mark.parametrize("text", ["ACGTACCTGA", "AAAAAC", "ACGACGACG", "ACGTTGCATTACGTTGCAGG"])
def test_unitigs(spark, text):
    k = 4
    counts = Counter(text[i : i + k] for i in range(len(text) - k + 1))
    got = sorted(r.seq for r in G.unitigs(spark.createDataFrame(list(counts.items()), "kmer string, n long"), k).collect())
    assert got == unitigs(counts, k)


def test_components_and_cover(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), *[(i, i + 1) for i in range(20, 60)]]
    got = dict(map(tuple, G.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()))
    assert got[3] == 1 and got[8] == 7 and got[9] == 9 and got[60] == 20
    members = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("z", 3), ("z", 1), ("z", 2)], "g string, i int")
    assert G.greedy_cover(members, "g", "i", 10) == ["z"]


def test_kmers(spark):
    one = spark.createDataFrame([("ACGNACGT",)], "bases string")
    assert one.select(S.defined_kmers(F.col("bases"), 3)).first()[0] == ["ACG", "ACG", "CGT"]
    assert sorted(one.select(K.mutants(F.lit("AC"))).first()[0]) == sorted({"AC", "CC", "GC", "TC", "AA", "AG", "AT"})
    key = one.select(S.packed_kmer(F.lit("ACGT")).alias("k")).first().k
    assert key == 0b00011011 and one.select(S.unpacked_kmer(F.lit(key), 4)).first()[0] == "ACGT"
    assert one.select(S.reverse_complement(F.lit("AACGN"))).first()[0] == "NCGTT"


def test_sketches(spark):
    rows = [("a", ["x%d" % i for i in range(100)]), ("b", ["x%d" % i for i in range(50, 150)]), ("c", ["y"])]
    df = spark.createDataFrame(rows, "g string, w array<string>")
    made = K.sketch(df, "g", F.col("w"), 1000)
    got = {(r.q, r.r): (r.hits, r.wkid) for r in K.compare_sketches(made, made, "g", 1000).collect()}
    assert got["a", "b"] == (50, 0.5) and got["c", "c"] == (1, 1.0) and ("a", "c") not in got


def test_approximate_distinct(spark):
    row = plans.QUERIES["approximate_distinct"](spark, SF).first()
    exact = plans.QUERIES["kmer_count_exact"](spark, SF).count()
    assert abs(row.estimate - exact) < 0.1 * exact


def test_samples(spark):
    rows = spark.range(20000)
    part = T.sample_rows(rows, F.col("id"), 0.1)
    assert abs(part.count() - 2000) < 250 and part.exceptAll(T.sample_rows(rows.repartition(3), F.col("id"), 0.1)).isEmpty()
    assert T.exact_sample(rows, F.col("id"), 77).count() == 77


def test_headers_numbers_cigars(spark):
    one = spark.range(1)
    assert one.select(S.suffixed_number(F.lit("1.5k")), S.boolean_of(F.lit("T")), S.cigar_length(F.lit("5S10M2D3I4M"), "MDN=X"), S.hamming(F.lit("abc"), F.lit("abd"))).first()[:] == (1500.0, True, 16, 1)


def test_covering_set_covers(spark):
    chosen = [r.source for r in plans.QUERIES["covering_set"](spark, SF).collect()]
    assert chosen and len(set(chosen)) == len(chosen)


def reads_of(spark, table="documents", key="doc_id"):
    return {r[key]: "".join(c for c in r.text.upper() if c in "ACGTN") for r in spark.read.parquet(f"{SF}/{table}.parquet").collect() if r.text is not None}


def ten_mers(bases):
    return [b for i in range(len(bases) - 9) if "N" not in (b := bases[i : i + 10])]


def test_whole_hamming_join(spark):
    index = {k[:i] + a + k[i + 1 :] for b in reads_of(spark, "benchmark", "item_id").values() for k in ten_mers(b) for i in range(10) for a in "ACGT"}
    want = {i: n for i, b in reads_of(spark).items() if (n := sum(k in index for k in ten_mers(b))) >= 3}
    assert {r.id: r.hits for r in plans.QUERIES["kmer_hamming_join"](spark, SF).collect()} == want and want


def test_whole_positions(spark):
    every = reads_of(spark).values()
    want = Counter((pos, b) for bases in every for pos, b in enumerate(bases))
    assert {(r.pos, r.base): r.n for r in plans.QUERIES["base_by_position"](spark, SF).collect()} == want
    at = defaultdict(list)
    for bases in every:
        for i in range(len(bases)):
            at[i].append((i * 7 + (i % 31) * (i % 17) + len(bases)) % 41)
    got = {r.pos: r for r in plans.QUERIES["quality_by_position"](spark, SF).collect()}
    assert set(got) == set(at) and max(at) >= 150
    for pos, q in at.items():
        r, s = got[pos], sorted(q)
        assert (r.low, r.high, r.n, r.median) == (s[0], s[-1], len(s), (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2) and abs(r["mean"] - sum(s) / len(s)) < 1e-8


def test_whole_pairs(spark):
    want = defaultdict(lambda: [None, None])
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        want[r.conv_id, r.turn // 2][r.turn % 2] = max(want[r.conv_id, r.turn // 2][r.turn % 2] or "", r.text)
    got = {(r.name, r.number): [r.one, r.two] for r in plans.QUERIES["repair_pairs"](spark, SF).collect()}
    assert got == want and any(number for _, number in got)


def test_base48_of_numbers_just_below_a_power(spark):
    numbers = [0, 1, 47, 48, 1000 * 7919 * 104729] + [48**i * d - 1 for i in range(1, 12) for d in (1, 2, 47)] + [48**12 - 1]
    rows = spark.createDataFrame([(Decimal(n),) for n in numbers], "n decimal(38,0)").select("n", X.encoded48(F.col("n")).alias("code"))

    def plain(n):
        text = ""
        while n:
            n, d = divmod(n, 48)
            text = chr(48 + d) + text
        return text or "0"

    assert [r.code for r in rows.collect()] == [plain(n) for n in numbers]
