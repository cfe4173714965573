"""Alignments and variants over made-up alignments of documents: each read has clips, an insertion, a deletion and two mismatches at places that follow from its id and length."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import alignments as A
from seqloom.operators import intervals as I
from seqloom.operators import variants as V
from seqloom.plans.registry import READS, query, reads

SHAPE = READS + """, shape AS (SELECT id, bases, id % 7 AS a, id % 5 AS b, id % 3 AS i, id % 4 AS d, CAST(floor((len(bases) - id % 7 - id % 5 - id % 3) / 2) AS BIGINT) AS m, (id * 37) % 500 + 1 AS pos, 's' || CAST(id % 5 AS VARCHAR) AS scaf, CAST((id % 2) * 16 + CASE WHEN id % 3 = 0 THEN 1024 ELSE 0 END AS INTEGER) AS flag, id % 61 AS mapq FROM reads WHERE len(bases) >= 40),
al AS (SELECT *, len(bases) - a - b - i - m AS m2, 'r' || CAST(id AS VARCHAR) AS qname FROM shape),
aln AS (SELECT *, (CASE WHEN a > 0 THEN a || 'S' ELSE '' END) || m || 'M' || (CASE WHEN i > 0 THEN i || 'I' ELSE '' END) || (CASE WHEN d > 0 THEN d || 'D' ELSE '' END) || m2 || 'M' || (CASE WHEN b > 0 THEN b || 'S' ELSE '' END) AS cigar,
  (m - 3) || 'A' || (CASE WHEN d > 0 THEN '2^' || repeat('C', d) || (m2 - 5) ELSE CAST(m2 - 3 AS VARCHAR) END) || 'G4' AS md FROM al)"""


def alignments(t):
    """``(qname, flag, scaf, pos, mapq, cigar, md, bases)`` and the numbers they are made from."""
    n = F.length("bases")
    s = reads(t).filter(n >= 40).select("id", "bases", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 3).alias("i"), (F.col("id") % 4).alias("d"), ((F.col("id") * 37) % 500 + 1).alias("pos"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("scaf"), ((F.col("id") % 2) * 16 + F.when(F.col("id") % 3 == 0, 1024).otherwise(0)).cast("int").alias("flag"), (F.col("id") % 61).alias("mapq"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("qname"))
    s = s.withColumn("m", F.floor((n - F.col("a") - F.col("b") - F.col("i")) / 2)).withColumn("m2", n - F.col("a") - F.col("b") - F.col("i") - F.col("m"))
    part = lambda c, op: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(part("a", "S"), part("m", "M"), part("i", "I"), part("d", "D"), part("m2", "M"), part("b", "S"))
    tail = F.when(F.col("d") > 0, F.concat(F.lit("2^"), F.repeat(F.lit("C"), F.col("d").cast("int")), (F.col("m2") - 5).cast("string"))).otherwise((F.col("m2") - 3).cast("string"))
    return s.withColumns({"cigar": cigar, "md": F.concat((F.col("m") - 3).cast("string"), F.lit("A"), tail, F.lit("G4"))})


@query(f"""WITH {SHAPE}, o AS (SELECT qname, pos, unnest(list_zip(regexp_extract_all(cigar, '\\d+[MIDS]'), range(1, len(regexp_extract_all(cigar, '\\d+[MIDS]')) + 1))) AS z FROM aln),
p AS (SELECT qname, pos, z[2] AS k, CAST(regexp_extract(z[1], '\\d+') AS INTEGER) AS len, right(z[1], 1) AS op FROM o)
SELECT qname, op, len, CAST(coalesce(sum(CASE WHEN op <> 'D' THEN len ELSE 0 END) OVER w, 0) AS INTEGER) AS read_at, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w, 0) AS INTEGER) AS ref_at FROM p WINDOW w AS (PARTITION BY qname ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cigar_walk(t):
    return alignments(t).select("qname", F.explode(A.cigar_blocks(F.col("cigar"), F.col("pos"))).alias("x")).select("qname", "x.*")


@query(f"WITH {SHAPE} SELECT qname, repeat('S', a) || repeat('M', m) || repeat('I', i) || repeat('D', d) || repeat('M', m2) || repeat('S', b) AS match, CASE WHEN i + d = 0 THEN (CASE WHEN a > 0 THEN a || 'S' ELSE '' END) || (m + m2) || 'M' || (CASE WHEN b > 0 THEN b || 'S' ELSE '' END) ELSE cigar END AS cigar FROM aln")
def match_strings(t):
    """Match strings, and the CIGARs made of them again."""
    made = alignments(t).select("qname", A.match_string(F.col("cigar")).alias("match"))
    return made.withColumn("cigar", A.cigar_of(F.col("match")))


@query(f"WITH {SHAPE} SELECT qname, CAST(pos - a AS BIGINT) AS pos, CASE WHEN i + d = 0 THEN (a + m + m2 + b) || 'M' ELSE (a + m) || 'M' || CASE WHEN i > 0 THEN i || 'I' ELSE '' END || CASE WHEN d > 0 THEN d || 'D' ELSE '' END || (m2 + b) || 'M' END AS cigar FROM aln")
def untrim_clips(t):
    return alignments(t).select("qname", A.unclipped(F.col("cigar"), F.col("pos")).alias("u")).select("qname", "u.pos", "u.cigar")


@query(f"""WITH {SHAPE} SELECT qname, CAST(m - 3 AS INTEGER) AS ref_off, 'A' AS ref, false AS deleted FROM aln UNION ALL SELECT qname, CAST(m AS INTEGER), repeat('C', d), true FROM aln WHERE d > 0 UNION ALL SELECT qname, CAST(m + d + m2 - 5 AS INTEGER), 'G', false FROM aln""")
def md_walk(t):
    return alignments(t).select("qname", F.explode(A.md_events(F.col("md"))).alias("x")).select("qname", "x.*")


@query(f"WITH {SHAPE} SELECT qname, 2 AS subs, CAST(i AS INTEGER) AS ins, CAST(d AS INTEGER) AS dels, CAST(a + b AS INTEGER) AS clipped, round((m + m2 - 2) / (m + m2 + i + d), 9) AS identity FROM aln")
def alignment_edits(t):
    e = alignments(t).select("qname", A.edits(F.col("cigar"), F.col("md")).alias("e"))
    return e.select("qname", "e.subs", "e.ins", "e.dels", "e.clipped", F.round("e.identity", 9).alias("identity"))


@query(f"WITH {SHAPE} SELECT qname FROM aln WHERE (m + m2 - 2) / (m + m2 + i + d) >= 0.98 AND d <= 2 AND i <= 1 AND a + b <= 6")
def identity_filter(t):
    return V.edit_filter(alignments(t), min_identity=0.98, dels=2, ins=1, clipped=6).select("qname")


@query(f"WITH {SHAPE} SELECT qname FROM aln WHERE i = 0 AND d = 0")
def substitution_reads(t):
    return V.substitutions_only(alignments(t), most=3).select("qname")


ALLELES = f"""{SHAPE}, obs AS (SELECT qname, scaf, CAST(pos + m - 3 AS INTEGER) AS pos, 'sub' AS kind, 'A' AS ref, substring(bases, a + m - 2, 1) AS alt, flag, mapq FROM aln
UNION ALL SELECT qname, scaf, CAST(pos + m + d + m2 - 5 AS INTEGER), 'sub', 'G', substring(bases, a + m + i + m2 - 4, 1), flag, mapq FROM aln
UNION ALL SELECT qname, scaf, CAST(pos + m - 1 AS INTEGER), 'ins', '', substring(bases, a + m + 1, i), flag, mapq FROM aln WHERE i > 0
UNION ALL SELECT qname, scaf, CAST(pos + m - 1 AS INTEGER), 'del', repeat('C', d), '', flag, mapq FROM aln WHERE d > 0)"""


@query(f"WITH {ALLELES} SELECT qname, scaf, pos, kind, ref, alt, CASE WHEN flag & 16 = 0 THEN 1 ELSE 0 END AS plus, mapq FROM obs")
def read_alleles(t):
    return V.read_alleles(alignments(t))


CALLS = f"""{ALLELES}, counted AS (SELECT scaf, pos, kind, ref, alt, count(*) AS n, CAST(sum(CASE WHEN flag & 16 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS plus, CAST(sum(mapq) AS BIGINT) AS mapq_sum, max(mapq) AS mapq_max FROM obs GROUP BY ALL),
deep AS (SELECT c.*, greatest((SELECT count(*) FROM aln x WHERE x.scaf = c.scaf AND x.pos <= c.pos AND c.pos < x.pos + x.m + x.d + x.m2), c.n) AS depth FROM counted c)"""


def called(t):
    aln = alignments(t)
    spans = aln.select("scaf", F.col("pos").alias("start"), A.stop_of(F.col("cigar"), F.col("pos")).alias("stop"))
    return V.with_depth(V.variant_counts(V.read_alleles(aln)), I.depth_segments(spans, ["scaf"]).filter("depth > 0"))


@query(f"WITH {CALLS} SELECT scaf, pos, kind, ref, alt, n, plus, depth, round(n / depth, 9) AS fraction FROM deep")
def variant_depth(t):
    """Alleles of reads with the coverage at their places."""
    return called(t).select("scaf", "pos", "kind", "ref", "alt", "n", "plus", "depth", F.round("fraction", 9).alias("fraction"))


@query(f"""WITH {CALLS}, f AS (SELECT *, n / depth AS fraction, least(plus, n - plus) AS minor, greatest(plus, n - plus) AS major FROM deep), s AS (SELECT *, (1 - pow(0.5, n)) * sqrt(least(fraction, 1.0)) * sqrt((minor + 1) / (major + 1)) * least(mapq_sum / n / 60, 1.0) AS score FROM f WHERE n >= 1 AND mapq_max >= 20 AND fraction >= 0.02 AND NOT n * 10.0 > mapq_sum AND NOT n * 0.0 > minor)
SELECT scaf, pos, kind, ref, alt, round(score, 9) AS score, round(CASE WHEN score > 0 THEN -25 * log10(1 - 0.998 * score) ELSE 0 END, 6) AS phred FROM s WHERE score >= 0.05""")
def variant_full_filter(t):
    out = V.variant_tiers(called(t), min_reads=1, min_fraction=0.02, min_strand=0.0, min_score=0.05)
    return out.select("scaf", "pos", "kind", "ref", "alt", F.round("score", 9).alias("score"), F.round("phred", 6).alias("phred"))


@query(f"WITH {CALLS}, bad AS (SELECT o.qname, count(*) AS k FROM obs o WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.scaf = o.scaf AND c.pos = o.pos AND c.kind = o.kind AND c.ref = o.ref AND c.alt = o.alt AND c.n >= 2) GROUP BY 1) SELECT qname FROM aln WHERE qname NOT IN (SELECT qname FROM bad WHERE k > 2)")
def unsupported_variation_filter(t):
    aln = alignments(t)
    own = V.read_alleles(aln)
    return V.unsupported_filter(aln, own, V.variant_counts(own).filter("n >= 2"), 2).select("qname")


@query(f"""WITH {SHAPE}, k AS (SELECT qname, scaf, flag & 16 AS minus, CASE WHEN flag & 16 > 0 THEN pos + m + d + m2 + b - 1 ELSE pos - a END AS five, (2 + i + d) / len(bases) AS error FROM aln)
SELECT qname FROM (SELECT qname, row_number() OVER (PARTITION BY scaf, minus, five ORDER BY error, qname) AS r FROM k) WHERE r = 1""")
def dedupe_by_mapping(t):
    e = A.edits(F.col("cigar"), F.col("md"))
    rows = alignments(t).withColumn("e", e)
    return V.mapping_duplicates(rows, (F.col("e.subs") + F.col("e.ins") + F.col("e.dels")) / F.length("bases")).select("qname")


@query(f"WITH {SHAPE} SELECT scaf, count(*) AS reads, CAST(sum(CASE WHEN flag & 16 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS reverse, CAST(sum(CASE WHEN flag & 1024 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(len(bases)) AS BIGINT) AS bases, CAST(sum(a + b) AS BIGINT) AS clipped, 2 * count(*) AS subs, CAST(sum(i) AS BIGINT) AS ins, CAST(sum(d) AS BIGINT) AS dels, round(avg((m + m2 - 2) / (m + m2 + i + d)), 9) AS mean_identity, round(avg(mapq), 9) AS mean_mapq FROM aln GROUP BY scaf")
def alignment_statistics(t):
    return V.alignment_statistics(alignments(t)).withColumns({c: F.round(c, 9) for c in ("mean_identity", "mean_mapq")})


@query(f"""WITH {SHAPE}, x AS (SELECT qname, scaf, flag & 16 AS f, pos FROM aln WHERE id % 11 <> 0), y AS (SELECT qname, CASE WHEN id % 13 = 0 THEN 's9' ELSE scaf END AS scaf, flag & 16 AS f, pos + CASE WHEN id % 6 = 0 THEN 15 WHEN id % 6 = 1 THEN 90 ELSE 0 END AS pos FROM aln WHERE id % 17 <> 0)
SELECT count(*) FILTER (x.scaf = y.scaf AND x.f = y.f AND x.pos = y.pos) AS strict, count(*) FILTER (x.scaf = y.scaf AND x.f = y.f AND abs(x.pos - y.pos) <= 20) AS loose, count(*) FILTER (x.qname IS NOT NULL AND y.qname IS NOT NULL AND NOT (x.scaf = y.scaf AND x.f = y.f AND abs(x.pos - y.pos) <= 20)) AS wrong, count(*) FILTER (x.qname IS NULL) AS unmapped, count(*) FILTER (y.qname IS NULL) AS extra FROM x FULL JOIN y ON x.qname = y.qname""")
def alignment_comparison(t):
    aln = alignments(t)
    truth = aln.filter("id % 17 <> 0").withColumns({"scaf": F.when(F.col("id") % 13 == 0, "s9").otherwise(F.col("scaf")), "pos": F.col("pos") + F.when(F.col("id") % 6 == 0, 15).when(F.col("id") % 6 == 1, 90).otherwise(0)})
    return V.graded(aln.filter("id % 11 <> 0"), truth)


SEGMENTS = """ev AS (SELECT scaf, x, sum(v) AS v FROM (SELECT scaf, start AS x, 1 AS v FROM spans UNION ALL SELECT scaf, stop, -1 FROM spans) GROUP BY 1, 2 HAVING sum(v) <> 0),
seg AS (SELECT scaf, x AS start, lead(x) OVER (PARTITION BY scaf ORDER BY x) AS stop, CAST(sum(v) OVER (PARTITION BY scaf ORDER BY x) AS BIGINT) AS depth FROM ev)"""


@query(f"WITH {SHAPE}, p AS (SELECT CAST(floor(id / 10) AS BIGINT) * 5 + id % 5 AS pair, * FROM aln), spans AS (SELECT min(scaf) AS scaf, min(pos) AS start, max(pos + m + d + m2) AS stop FROM p GROUP BY pair HAVING count(*) = 2 AND min(scaf) = max(scaf)), {SEGMENTS} SELECT scaf, start, stop, depth FROM seg WHERE stop IS NOT NULL")
def physical_coverage(t):
    pair = F.floor(F.col("id") / 10) * 5 + F.col("id") % 5
    return I.depth_segments(V.physical_spans(alignments(t), pair), ["scaf"])


READ_SPANS = f"WITH {SHAPE}, spans AS (SELECT scaf, pos AS start, pos + m + d + m2 AS stop FROM aln), {SEGMENTS}"


def _segments(t):
    return I.depth_segments(alignments(t).select("scaf", F.col("pos").alias("start"), A.stop_of(F.col("cigar"), F.col("pos")).alias("stop")), ["scaf"]).filter("depth > 0")


@query(READ_SPANS + """, x AS (SELECT scaf, depth, unnest(range(start, stop)) AS p FROM seg WHERE stop IS NOT NULL AND depth > 0), b AS (SELECT scaf, CAST(floor(p / 100) AS BIGINT) AS bin, CAST(sum(depth) AS BIGINT) AS bases FROM x GROUP BY 1, 2)
SELECT scaf, bin, bases, round(bases / 100, 9) AS mean_depth, round(bases / avg(bases) OVER (PARTITION BY scaf), 9) AS normalised FROM b""")
def coverage_bins(t):
    return V.binned_coverage(_segments(t), "scaf", 100).withColumns({c: F.round(c, 9) for c in ("mean_depth", "normalised")})


GENES = "genes AS (SELECT 's' || CAST(k % 5 AS VARCHAR) AS scaf, 'g' || CAST(k AS VARCHAR) AS gene, (k * 53) % 1500 AS start, (k * 53) % 1500 + 90 + (k * 7) % 200 AS stop FROM (SELECT unnest(range(60)) AS k))"


@query(READ_SPANS + f""", {GENES}, x AS (SELECT scaf, depth, unnest(range(start, stop)) AS p FROM seg WHERE stop IS NOT NULL AND depth > 0)
SELECT gene, CAST(coalesce(sum(depth), 0) AS BIGINT) AS bases, count(depth) AS covered, round(count(depth) / max(stop - start), 9) AS fraction, round(coalesce(sum(depth), 0) / max(stop - start), 9) AS mean_depth FROM genes g LEFT JOIN x ON x.scaf = g.scaf AND p >= start AND p < stop GROUP BY gene""")
def gene_coverage(t):
    """Coverage of genes or transcripts: bases, share captured, mean depth."""
    spark = t("region").sparkSession
    k = F.col("id")
    genes = spark.range(60).select(F.concat(F.lit("s"), (k % 5).cast("string")).alias("scaf"), F.concat(F.lit("g"), k.cast("string")).alias("gene"), ((k * 53) % 1500).alias("start"), ((k * 53) % 1500 + 90 + (k * 7) % 200).alias("stop"))
    return V.interval_coverage(genes, _segments(t), "scaf", "gene").withColumns({c: F.round(c, 9) for c in ("fraction", "mean_depth")})


@query(f"WITH {ALLELES}, c AS (SELECT scaf, pos, kind, alt, least(sum(CASE WHEN mapq > 30 THEN 2 ELSE 1 END), 4) AS dosage FROM obs GROUP BY ALL) SELECT scaf, pos, kind, alt, CAST(dosage AS BIGINT) AS dosage, rtrim(repeat('0/', CAST(4 - dosage AS BIGINT)) || repeat('1/', CAST(dosage AS BIGINT)), '/') AS genotype FROM c")
def dosage_merge(t):
    own = V.read_alleles(alignments(t)).withColumn("copies", F.when(F.col("mapq") > 30, 2).otherwise(1))
    return V.dosage_merge(own, ["scaf", "pos", "kind", "alt"], "copies", 4)
