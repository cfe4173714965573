import random

import pytest
from pyspark.sql import functions as F

from seqloom import sources, streaming
from seqloom.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_blocks_and_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{i} x", "".join(rng.choice("ACGTN") for _ in range(n)), [rng.choice([31, 2, 40]) for _ in range(n)]) for i, n in enumerate(rng.randrange(1, 90) for _ in range(3000))]
    body = "".join(f"@{i}\n{b}\n+\n{''.join(chr(x + 33) for x in q)}\n" for i, b, q in rows)  # 31 is the mark @
    path = put(tmp_path / "a.fastq", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.read_fastq(spark, path)
        assert got.rdd.getNumPartitions() >= 1
        assert [(r.id, r.bases, r.quals) for r in got.orderBy("numeric_id").collect()] == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sources.write(got.orderBy("numeric_id"), str(tmp_path / "out"), "fastq", compression="gzip")
    assert sorted(r.id for r in readers.read_fastq(spark, str(tmp_path / "out")).collect()) == sorted(r[0] for r in rows)


def test_pairs(spark, tmp_path):
    a, b = put(tmp_path / "1.fq", "@x/1\nA\n+\nI\n@y/1\nC\n+\nI\n"), put(tmp_path / "2.fq", "@x/2\nG\n+\nI\n")
    got = {r.numeric_id: r for r in readers.read_fastq_pair(spark, a, b).collect()}
    assert not got[0].mate_missing and got[0].bases2 == "G" and got[1].mate_missing
    both = readers.read_fastq(spark, a, interleaved=True).orderBy("pairnum").collect()
    assert [(r.numeric_id, r.pairnum) for r in both] == [(0, 0), (0, 1)]


def test_fasta_and_qual(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">one two\nACGT\nAC\n>three\n\n>four\nGG\n")
    rows = {r.id: r.bases for r in sources.read(spark, path).collect()}
    assert rows == {"one two": "ACGTAC", "three": "", "four": "GG"}
    quals = {r.id: r.quals for r in readers.read_qual(spark, put(tmp_path / "a.qual", ">one two\n1 2 3\n4 5 6\n")).collect()}
    assert quals == {"one two": [1, 2, 3, 4, 5, 6]}
    sources.write_fasta(spark.createDataFrame([("q", "A" * 150)], "id string, bases string"), str(tmp_path / "o"))
    assert readers.read_fasta(spark, str(tmp_path / "o")).first().bases == "A" * 150


def test_sam_vcf_gff_bed(spark, tmp_path):
    sam = readers.read_sam(spark, put(tmp_path / "a.sam", "@HD\tVN:1.6\n@SQ\tSN:c\tLN:9\nr\t16\tc\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tXA:Z:a:b\n"))
    row = sam.first()
    assert (row.qname, row.flag, row.pos, row.cigar, row.tags) == ("r", 16, 3, "4M", {"NM:i": "1", "XA:Z": "a:b"})
    assert readers.sam_header(spark, str(tmp_path / "a.sam")).filter("kind = 'SQ'").first().fields == {"SN": "c", "LN": "9"}
    sources.write_sam(sam, str(tmp_path / "s"))
    assert readers.read_sam(spark, str(tmp_path / "s")).collect() == sam.collect()
    vcf = readers.read_vcf(spark, put(tmp_path / "a.vcf", "##fileformat=VCFv4.2\n#CHROM\nc\t5\t.\tAT\tA\t.\tPASS\tDP=7;AF=0.5\tGT\t0/1\t1/1\n"))
    row = vcf.first()
    assert (row.pos, row.qual, row["info"], row.samples) == (5, None, {"DP": "7", "AF": "0.5"}, ["0/1", "1/1"])
    assert readers.padded_spans(vcf, 10).first()[:] == ("c", 0, 16)
    sources.write_vcf(vcf, str(tmp_path / "v"))
    assert readers.read_vcf(spark, str(tmp_path / "v")).first().pos == 5
    gff = readers.read_gff(spark, put(tmp_path / "a.gff", '##gff-version 3\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=x\nc\ts\texon\t1\t4\t.\t+\t0\tgene_id "g1"; exon "2";\n')).orderBy("stop").collect()
    assert gff[1].attributes == {"ID": "g1", "Name": "x"} and gff[0].attributes == {"gene_id": "g1", "exon": "2"}
    assert readers.read_bed(spark, put(tmp_path / "a.bed", "track x\nc\t1\t5\textra\n")).first()[:] == ("c", 1, 5)


def test_other_formats(spark, tmp_path):
    assert readers.read_oneline(spark, put(tmp_path / "a.oneline", "n\tACGT\n")).first()[:] == ("n", "ACGT")
    assert readers.read_gfa(spark, put(tmp_path / "a.gfa", "H\tVN\nS\t1\tACG\nL\t1\n")).first()[:] == ("1", "ACG")
    assert readers.read_scarf(spark, put(tmp_path / "a.scarf", "M:1:2:ACG:hhh\n")).first()[:] == ("M:1:2", "ACG", [40, 40, 40])
    gb = readers.read_genbank(spark, put(tmp_path / "a.gb", "LOCUS       AB1  9 bp\nFEATURES\n     gene            1..9\nORIGIN\n        1 acgta cgta\n//\n")).first()
    assert gb.id == "AB1" and gb.bases == "ACGTACGTA" and gb.features[0].type == "gene"
    assert sorted(map(tuple, readers.read_phylip(spark, put(tmp_path / "a.phy", "2 6\nx ACG\ny TTT\n\nAAA\nCCC\n")).collect())) == [("x", "ACGAAA"), ("y", "TTTCCC")]
    assert readers.read_histogram(spark, put(tmp_path / "h", "#x\tn\n1\t5\n")).first()[:] == (1, 5)
    assert readers.read_matrix(spark, put(tmp_path / "m", "#dims\t2\t1\n1\t2\t0\n"), 2).first()[:] == ([1.0, 2.0], [0.0])
    assert readers.read_taxonomy(spark, put(tmp_path / "n", "1\t|\t1\t|\tno rank\t|\n")).first()[:] == (1, 1, "no rank")
    assert readers.read_coverage(spark, put(tmp_path / "c", "#ID\tAvg_fold\na\t2.5\n")).first()[:] == ("a", 2.5)
    assert readers.read_names(spark, put(tmp_path / "names", ">a\na\nb\n")).count() == 2


@pytest.mark.parametrize(("name", "line", "want"), [("x.fq.gz", None, ("fastq", "gz")), ("a/b.FASTA", None, ("fasta", None)), ("q", "@HD\tVN", ("sam", None)), ("q", ">x", ("fasta", None)), ("q.bin", "##fileformat=VCFv4", ("vcf", None)), ("q", "?", ("text", None))])
def test_detection(name, line, want):
    assert sources.detect(name, line) == want


def test_sniff_and_routes(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACG", [1, 2, 3]), ("b", "A", [40])], "id string, bases string, quals array<int>")
    row = sources.sniff(reads).first()
    assert (row.reads, row.min_length, row.max_length, row.min_quality, row.max_quality) == (2, 1, 3, 1, 40)
    sources.write(reads.withColumn("route", F.col("id")), str(tmp_path / "r"), "parquet", by="route")
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"route=a", "route=b"}
    sources.write(reads, "", "null")


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    live = lambda: streaming.stream(spark, str(tmp_path / "e"), events.schema)
    got = streaming.to_memory(streaming.windowed(live(), "ts", "1 hour", ["event_type"], late="400 days", total="value"), "w", "complete")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))
    seen = streaming.to_memory(streaming.first_seen(live(), ["user_id"], "ts", "400 days"), "f")
    assert seen.count() == events.select("user_id").distinct().count()
    s = streaming.to_memory(streaming.sessions(live(), "ts", "30 minutes", ["user_id"], "400 days"), "s", "complete")
    assert s.agg(F.sum("n")).first()[0] == events.count()
    parts = []
    streaming.running(live(), lambda df, i: parts.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(parts) == events.count()
