"""Methods without an SQL twin against plain versions, plug-ins, the command line, further sources."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom import __main__ as cli
from seqloom import plans, plugins, sources
from seqloom.functions import alignments as AL
from seqloom.operators import complexity, counting, matching, packed, rows
from seqloom.operators import composites as C
from seqloom.operators import orders as O

SF = "/root/testdata/sf0.001"


def test_best_path_against_all_sets(spark):
    rng = random.Random(3)
    items = [(k, a := rng.randrange(60), a + rng.randrange(1, 25), float(rng.randrange(1, 30))) for k in "xy" for _ in range(11)]
    got = C.best_path(spark.createDataFrame(items, "scaf string, start long, stop long, score double"), "scaf").collect()
    for k in "xy":
        own = [x for x in items if x[0] == k]
        sets = (s for n in range(len(own) + 1) for s in itertools.combinations(own, n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(s, 2)))
        chosen = [r for r in got if r.scaf == k]
        assert sum(r.score for r in chosen) == max(sum(x[3] for x in s) for s in sets)
        assert all(a.stop <= b.start or b.stop <= a.start for a, b in itertools.combinations(chosen, 2))


def test_peaks_ploidy_and_valleys(spark):
    import math

    hill = lambda x, at, wide, high: high * math.exp(-((x - at) ** 2) / (2 * wide**2))
    diploid = [0] + [round(hill(x, 0, 2, 5000) + hill(x, 20, 4, 300) + hill(x, 40, 5, 900)) for x in range(1, 80)]
    peaks = C.call_peaks(diploid)
    assert [abs(p["center"] - c) <= 1 for p, c in zip(peaks, (20, 40), strict=True)] == [True, True]
    found = C.genome_size(peaks, diploid)
    true = sum(d * n for d, n in enumerate(diploid) if d >= peaks[0]["start"]) / 40
    assert found["ploidy"] == 2 and abs(found["size"] - true) <= 0.03 * true and 0 < found["heterozygous"] < 0.5
    one = [0] + [round(hill(x, 0, 2, 5000) + hill(x, 30, 4, 900)) for x in range(1, 70)]
    assert C.genome_size(C.call_peaks(one), one)["ploidy"] == 1
    assert 20 < C.valley_bounds(diploid, 2)[0] < 40 and C.call_peaks([0, 0, 0]) == [] and C.genome_size([], [0])["size"] == 0
    table = C.peak_table(spark.createDataFrame(list(enumerate(diploid)), "x int, y int"), "x", "y").collect()
    assert [r.center for r in table] == [p["center"] for p in peaks]


def test_greedy_clusters_one_by_one(spark):
    rng = random.Random(5)
    ids = list(range(60))
    near = {(a, b) for a in ids for b in ids if a < b and rng.random() < 0.06}
    rank = {i: rng.randrange(10) for i in ids}
    got = {r.id: r.center for r in C.greedy_clusters(spark.createDataFrame(list(rank.items()), "id long, rank int"), spark.createDataFrame(list(near), "a long, b long"), "rank").collect()}
    centers, want = [], {}
    for i in sorted(ids, key=lambda x: (rank[x], x)):
        first = next((c for c in centers if (min(c, i), max(c, i)) in near), None)
        want[i] = i if first is None else first
        if first is None:
            centers.append(i)
    assert got == want


def test_scaffolds_follow_links(spark):
    contigs = spark.createDataFrame([(x, x * 3) for x in "ABCDE"], "id string, bases string")
    links = spark.createDataFrame([("A", "B"), ("B", "C"), ("E", "D")], "before string, after string")
    assert {(r.scaffold, r.contigs, r.bases) for r in C.scaffolds(contigs, links, 2).collect()} == {("A", 3, "AAANNBBBNNCCC"), ("E", 2, "EEENNDDD")}


def test_bins_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    kinds = rng.dirichlet(np.ones(16), 3)
    made = [(i, (f := (kinds[i % 3] + rng.uniform(0, 0.002, 16))) / f.sum(), float(10 ** (i % 3) + rng.uniform(0, 0.2))) for i in range(30)]
    gc = lambda f: float(sum(f[a * 4 + b] * ((a in (1, 2)) + (b in (1, 2))) / 2 for a in range(4) for b in range(4)))
    rows_ = [(i, f.tolist(), gc(f), d) for i, f, d in made]
    got = {r.id: r.bin for r in C.bins(spark.createDataFrame(rows_, "id long, f array<double>, gc double, depth double"), "id", "f", "depth", 0.05, 1.5).collect()}
    root = {i: i for i, *_ in rows_}
    for (i, f, g, d), (j, h, k, e) in itertools.combinations(rows_, 2):
        if max(d, e) <= 1.5 * min(d, e) and sum(abs(x - y) for x, y in zip(f, h, strict=True)) <= 0.05:
            a, b = sorted((root[i], root[j]))
            root = {x: (a if r == b else r) for x, r in root.items()}
    assert got == root and len(set(root.values())) == 3


def test_tree_by_average_linkage():
    d = [("a", "b", 2.0), ("a", "c", 6.0), ("b", "c", 8.0), ("a", "d", 10.0), ("b", "d", 10.0), ("c", "d", 10.0)]
    assert C.newick(d) == "(((a:1,b:1):2.5,c:3.5):1.5,d:5);" and C.newick([]) == ";"
    with pytest.raises(ValueError):
        C.newick(d, most=3)


def test_packed_kmers_are_those_of_strings():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTN") if rng.random() < 0.2 else rng.choice("ACGT") for _ in range(rng.randrange(0, 90))) for _ in range(40)] + ["", None, "acgt"]
    turn = str.maketrans("ACGT", "TGCA")
    for k in (1, 2, 5, 11, 31):
        for canonical in (False, True):
            want = []
            for r, t in enumerate(texts):
                for i in range(len(t or "") - k + 1):
                    w = t[i : i + k].upper()
                    if not set(w) - set("ACGT"):
                        w = max(w, w.translate(turn)[::-1]) if canonical else w
                        want.append((int("".join("ACGT".index(c).__str__() for c in w), 4), r, i))
            keys, at, pos = packed.packed(pa.array(texts, pa.string()).slice(0), k, canonical)
            assert list(zip(keys.tolist(), at.tolist(), pos.tolist(), strict=True)) == want
    keys, at, _ = packed.packed(pa.array(["AC", "GT", "TTT"]).slice(1), 2)
    assert list(zip(keys.tolist(), at.tolist(), strict=True)) == [(11, 0), (15, 1), (15, 1)]


def test_count_min_is_never_below_and_prefilter_exact(spark):
    rng = random.Random(2)
    keys = spark.createDataFrame([(str(min(rng.randrange(200), rng.randrange(200))),) for _ in range(4000)], "k string")
    true = {r.k: r["count"] for r in keys.groupBy("k").count().collect()}
    made = {r.k: r.estimate for r in counting.estimates(keys, "k", counting.count_min(keys, "k", 3, 64), 3, 64).collect()}
    assert made.keys() == true.keys() and all(made[k] >= true[k] for k in true)
    assert {r.k: r.n for r in counting.prefiltered_counts(keys, "k", 20, width=64).collect()} == {k: v for k, v in true.items() if v >= 20}


def test_register_estimates_merge_and_err_little(spark):
    both = spark.range(20_000).withColumn("g", (F.col("id") % 2).cast("string"))
    made = counting.registers(both, "g", F.col("id"))
    whole = counting.register_estimate(made, None).first().estimate
    parts = {r.g: r.estimate for r in counting.register_estimate(made, "g").collect()}
    assert abs(whole - 20_000) < 3_500 and all(abs(v - 10_000) < 1_800 for v in parts.values())
    few = counting.register_estimate(counting.registers(both.limit(40), "g", F.col("id")), None).first().estimate
    assert abs(few - 40) < 8


def test_matches_of_odd_reads(spark):
    refs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "TTTTNACG"), (3, None)], "id long, bases string")
    reads = spark.createDataFrame([(1, "GGACGTACGG"), (2, ""), (3, None), (4, "NNNN"), (5, "GGGGGGGG")], "id long, bases string")
    hits = matching.found(reads, "id", "bases", 6, matching.index(refs, "id", "bases", 6))
    assert {(r.id, r.pos) for r in hits.collect()} == {(1, 2), (1, 3)}
    assert {r.id: r.bases for r in matching.mask(reads, hits, "id", "bases", 6).collect()} == {1: "GGNNNNNNNG", 2: "", 3: None, 4: "NNNN", 5: "GGGGGGGG"}
    assert {(r.id, r.piece): r.bases for r in matching.split(reads, hits, "id", "bases", 6).collect()} == {(1, 0): "GG", (1, 1): "G", (4, 0): "NNNN", (5, 0): "GGGGGGGG"}
    assert {r.id: r.bases for r in matching.trim(reads, hits, "id", "bases", 6, "left").collect()}[1] == "G"


def test_entropy_windows_by_counting():
    import math

    rng = random.Random(6)
    text = "".join(rng.choice("ACGTN") for _ in range(40)) + "A" * 50 + "".join(rng.choice("AC") for _ in range(30))
    got = complexity.window_entropies(text, 20, 3)
    for i, value in enumerate(got):
        words = [text[j : j + 3] for j in range(i, i + 18)]
        p = [words.count(w) / 18 for w in set(words)]
        assert abs(value + sum(x * math.log(x) for x in p) / math.log(18)) < 1e-9
    assert len(got) == len(text) - 19 and complexity.window_entropies("AC", 20, 3).size == 0


def test_md_and_cigar_by_hand(spark):
    one = spark.createDataFrame([("3S4M2I3M1D2M1H", "2A1G2^T2", 100, "NNNACCTGGAAACT")], "cigar string, md string, pos int, bases string")
    e = one.select(AL.edits(F.col("cigar"), F.col("md")).alias("e")).first().e
    assert (e.subs, e.ins, e.dels, e.clipped, e.matches) == (2, 2, 1, 4, 7)
    found = one.select(AL.alleles(F.col("cigar"), F.col("md"), F.col("pos"), F.col("bases")).alias("a")).first().a
    assert sorted((x.pos, x.kind, x.ref, x.alt) for x in found) == [(102, "sub", "A", "C"), (103, "ins", "", "GG"), (104, "sub", "G", "A"), (106, "del", "T", "")]
    u = one.select(AL.unclipped(F.col("cigar"), F.col("pos")).alias("u")).first().u
    assert (u.pos, u.cigar) == (97, "7M2I3M1D2M1H")


def test_name_filters_keep_repeated_rows(spark):
    r = spark.createDataFrame([("a",), ("a",), ("b",), ("bad",), (None,)], "x string")
    names = spark.createDataFrame([("a",)], "name string")
    got = lambda include, mode: sorted((y.x for y in rows.name_filter(r, names, "x", include, mode).collect()), key=str)
    assert got(True, "exact") == got(True, "prefix") == ["a", "a"] and got(True, "contains") == ["a", "a", "bad"]
    assert got(False, "prefix") == [None, "b", "bad"] or got(False, "prefix") == ["None", "b", "bad"] or [x for x in got(False, "prefix") if x] == ["b", "bad"]
    assert [x for x in got(False, "contains") if x] == ["b"]


def test_all_pairs_hold_each_pair_once(spark):
    made = C.all_pairs(spark.range(40).withColumn("p", F.col("id")), "id", "p", lambda x, y: x + y, block=7).collect()
    assert sorted((r.a, r.b, r.score) for r in made) == [(a, b, a + b) for a, b in itertools.combinations(range(40), 2)]


def test_upsample_and_bases(spark):
    df = spark.range(30).withColumn("n", F.col("id") + 1)
    assert O.upsample(df, F.col("id"), 100).count() == 100 and O.upsample(df, F.col("id"), 7).count() == 7 and O.upsample(df.limit(0), F.col("id"), 7).count() == 0
    some = [r.n for r in O.sample_bases(df, F.col("id"), F.col("n"), 100).collect()]
    assert sum(some) >= 100 and sum(some) - 30 < 100


def test_plug_ins(spark, tmp_path):
    class Longest:
        """The longest text seen."""

        def __init__(self):
            self.best = ""

        def add(self, batch):
            self.best = max([self.best, *batch.column(0).to_pylist()], key=lambda x: (len(x), x))

        def merge(self, other):
            self.best = max(self.best, other.decode(), key=lambda x: (len(x), x))

        def state(self):
            return self.best.encode()

    class Upper:
        schema = "x string"

        def process(self, batch):
            return pa.RecordBatch.from_pydict({"x": [v.upper() for v in batch.column(0).to_pylist()]})

    class NotB:
        def process(self, frame):
            return frame.filter("x <> 'B'")

    texts = spark.createDataFrame([("a",), ("bbb",), ("cc",), ("b",)], "x string").repartition(40)
    assert plugins.accumulate(texts, Longest, fan=3).best == "bbb"
    assert sorted(r.x for r in plugins.run_chain(texts, [Upper(), NotB(), lambda d: d.distinct()]).collect()) == ["A", "BBB", "CC"]
    pairs = spark.createDataFrame([("ACGT", "ACGA"), ("A", None)], "q string, t string")
    assert [r.identity for r in plugins.align_with(pairs, "hamming", "q", "t").collect()] == [0.75, None]
    assert plugins.align_with(pairs, "global", "q", "t").first().identity == 0.75
    many = spark.range(3000)
    assert plugins.count_distinct(many, "id", "exact").first().estimate == 3000
    assert all(abs(plugins.count_distinct(many, "id", n).first().estimate - 3000) < 600 for n in ("hll", "registers"))
    reads = spark.createDataFrame([("r1", "AC", 0), ("r2", "ACG", 0), ("r0", "T", 1)], "id string, bases string, pairnum int")
    assert [r.id for r in plugins.ordered(reads, "length").collect()] == ["r2", "r1", "r0"]
    assert [r.id for r in plugins.ordered(reads, "name", descending=True).collect()] == ["r2", "r1", "r0"]
    (tmp_path / "x.txt").write_text("a=1\nskip\nb=2\n")
    parse = lambda line: {"k": line.split("=")[0], "v": int(line.split("=")[1])} if "=" in line else None
    assert sorted((r.k, r.v) for r in plugins.parse_lines(spark, str(tmp_path / "x.txt"), parse, "k string, v int").collect()) == [("a", 1), ("b", 2)]
    assert plugins.run_jobs({"a": lambda: spark.range(5).count(), "b": lambda: 2}) == {"a": 5, "b": 2}


def test_command_line(spark, tmp_path):
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(["ACGTACGTAC", "ACG", "GTACGTACGT", "NNNNNNNNNN"])))
    src = f"in={tmp_path}/r.fq"
    assert sorted(r.id for r in cli.main(["filter", src, "minlength=5", "maxns=2", f"out={tmp_path}/o.parquet"], spark).collect()) == ["r0", "r2"]
    assert spark.read.parquet(f"{tmp_path}/o.parquet").count() == 2
    assert {r.id for r in cli.main(["dedupe", src, f"out={tmp_path}/d.parquet"], spark).collect()} == {"r0", "r1", "r3"}
    assert [r.id for r in cli.main(["sort", src, "by=length", f"out={tmp_path}/s.parquet"], spark).collect()][-1] == "r1"
    assert cli.main(["sample", src, "samplereadstarget=2", f"out={tmp_path}/p.parquet"], spark).count() == 2
    counted = {r.kmer: r.n for r in cli.main(["count", src, "k=10", f"out={tmp_path}/c.parquet"], spark).collect()}
    assert counted == {"GTACGTACGT": 2}
    assert cli.number({"x": "2k"}, "x") == 2000
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_more_sources(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert [tuple(r) for r in sources.read_accessions(spark, file("a", "accession\taccession.version\ttaxid\tgi\nA1\tA1.2\t9606\t77\n")).collect()] == [("A1", "A1.2", 9606, 77)]
    assert [tuple(r) for r in sources.read_gi_table(spark, file("g", "7\t9\n")).collect()] == [(7, 9)]
    got = sources.read_assembly_summary(spark, file("s", "#   note\n# assembly_accession\tbioproject\nGCF_1\tPRJ\n"))
    assert got.columns == ["assembly_accession", "bioproject"] and [tuple(r) for r in got.collect()] == [("GCF_1", "PRJ")]
    names = "9606\t|\tHomo sapiens\t|\t\t|\tscientific name\t|\n9606\t|\thuman\t|\t\t|\tcommon name\t|\n"
    assert [tuple(r) for r in sources.read_names_table(spark, file("n", names)).collect()] == [(9606, "Homo sapiens")]
    hmm = "# c\n" + "\n".join(f"t{i} - q - {e} {s} 0.1 1 1 0 1 1 0 0 1 1 1 1 a protein" for i, (e, s) in enumerate([("1e-20", 80), ("1e-9", 30), ("0.5", 3)])) + "\n"
    report = sources.read_hmm_report(spark, file("h", hmm))
    assert report.count() == 3 and [tuple(r) for r in sources.hmm_summary(report).collect()] == [("q", 2, "t0", 80.0)]
    assert [tuple(r) for r in sources.read_gfa_links(spark, file("f", "S\t1\tAC\nL\t1\t+\t2\t-\t3M\n")).collect()] == [("1", "+", "2", "-", "3M")]
    assert sources.twin_path("r_#.fq") == ("r_1.fq", "r_2.fq")
    assert sources.quality_offset(spark.createDataFrame([([31, 50],)], "quals array<int>")) == 64
    spans = spark.createDataFrame([("b", 5, 9), ("a", 1, 4)], "scaf string, start int, stop int")
    sources.write(spans, str(tmp_path / "o.bed"), "bed")
    assert [tuple(r) for r in sources.read_bed(spark, str(tmp_path / "o.bed")).orderBy("scaf").collect()] == [("a", 1, 4), ("b", 5, 9)]


@pytest.mark.parametrize("name", ["gene_path", "peak_calling", "frequency_clusters", "metagenome_bins", "network_training", "spectra_tree", "apply_variants"])
def test_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
