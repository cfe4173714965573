"""Composite methods over documents and the star schema."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import composites as C
from seqloom.operators import genomes as G
from seqloom.operators import packed as P
from seqloom.operators import sets as T
from seqloom.plans.kmer_queries import BENCH, BENCH_READS, bench_reads, bench_words, gram_hashes, gram_sql
from seqloom.plans.registry import READS, WORDS, kmer_sql, query, reads, words


@query()
def peak_calling(t):
    """Peaks of the 8-mer depth histogram; tested against a plain walk."""
    h = P.counts(reads(t), "bases", 8).groupBy(F.col("n").alias("depth")).agg(F.count(F.lit(1)).alias("kmers"))
    return C.peak_table(h, "depth", "kmers")


@query()
def gene_path(t):
    """Shipments of a customer that don't overlap, with the largest total; tested against trying all sets."""
    li = t("lineitem").select(F.col("l_suppkey").alias("scaf"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("stop"), F.col("l_extendedprice").alias("score"))
    return C.best_path(li, "scaf").groupBy("scaf").agg(F.count(F.lit(1)).alias("genes"), F.round(F.sum("score"), 2).alias("score"))


@query(f"WITH {READS} SELECT id, CAST(pos AS INTEGER) AS pos FROM {kmer_sql(8)} WHERE kmer = reverse(translate(kmer, 'ACGT', 'TGCA'))")
def palindromes(t):
    return G.palindromes(reads(t), "id", "bases", 8)


@query(f"WITH {READS}, n AS (SELECT id, pos, lead(pos) OVER (PARTITION BY id, kmer ORDER BY pos) AS other FROM {kmer_sql(9)}) SELECT id, CAST(pos AS INTEGER) AS pos, CAST(other AS INTEGER) AS other FROM n WHERE other - pos - 9 BETWEEN 15 AND 60")
def spaced_repeats(t):
    return C.spaced_repeats(reads(t), "id", "bases", 9, 15, 60)


@query(f"WITH {READS}, k AS {kmer_sql(9)} SELECT a.id, CAST(a.pos AS INTEGER) AS pos, CAST(b.pos AS INTEGER) AS other FROM k a JOIN k b ON a.id = b.id AND b.kmer = reverse(translate(a.kmer, 'ACGT', 'TGCA')) AND b.pos - a.pos - 9 BETWEEN 3 AND 80")
def inverted_repeats(t):
    return C.spaced_repeats(reads(t), "id", "bases", 9, 3, 80, inverted=True)


@query(f"WITH {READS}, c AS (SELECT greatest(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS c, kmer, count(*) AS n FROM {kmer_sql(8)} GROUP BY 1, 2), p AS (SELECT c, sum(CASE WHEN kmer = c THEN n ELSE 0 END) AS a, sum(CASE WHEN kmer = c THEN 0 ELSE n END) AS b FROM c WHERE c <> reverse(translate(c, 'ACGT', 'TGCA')) GROUP BY c) SELECT count(*) AS kmers, round(sum(greatest(a, b)) / sum(a + b), 9) AS strandedness FROM p")
def strandedness(t):
    return C.strand_balance(P.counts(reads(t), "bases", 8), 8).withColumn("strandedness", F.round("strandedness", 9))


@query(f"WITH {READS} SELECT id, CAST((len(bases) - len(replace(bases, 'NTNT', ''))) / 4 AS BIGINT) AS junctions, CASE WHEN strpos(bases, 'NTNT') > 0 THEN substring(bases, 1, strpos(bases, 'NTNT') + 1) ELSE bases END AS bases FROM reads WHERE len(bases) >= 1")
def junction_cut(t):
    return C.motif_cut(reads(t).select("id", "bases"), "bases", "NTNT")


@query(f"WITH {READS}, {BENCH_READS}, p AS (SELECT id AS primer, substring(bases, 1, 12) AS sequence FROM br WHERE len(bases) >= 12), w AS (SELECT id, i - 1 AS pos, substring(bases, i, 12) AS there FROM (SELECT id, bases, unnest(range(1, len(bases) - 10)) AS i FROM reads)), m AS (SELECT w.id, primer, pos, there, sequence FROM w JOIN p ON substring(there, 1, 6) = substring(sequence, 1, 6) UNION SELECT w.id, primer, pos, there, sequence FROM w JOIN p ON substring(there, 7, 6) = substring(sequence, 7, 6)), d AS (SELECT id, primer, pos, len(list_filter(range(1, 13), lambda i: there[i] <> sequence[i])) AS distance FROM m) SELECT id, primer, CAST(pos AS INTEGER) AS pos, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id, primer ORDER BY distance, pos) AS r FROM d WHERE distance <= 1) WHERE r = 1")
def primer_search(t):
    primers = bench_reads(t).filter(F.length("bases") >= 12).select(F.col("id").alias("primer"), F.substring("bases", 1, 12).alias("sequence"))
    return C.primer_hits(reads(t), primers, "id", "bases")


COUNTED = f"{READS}, n AS (SELECT kmer, count(*) AS n FROM {kmer_sql(10)} GROUP BY kmer)"


@query(f"""WITH {COUNTED}, d1 AS (SELECT a.kmer FROM n a WHERE substring(a.kmer, 2) NOT IN (SELECT substring(kmer, 1, 9) FROM n) AND a.n * 2.0 <= (SELECT max(b.n) FROM n b WHERE substring(b.kmer, 1, 9) = substring(a.kmer, 1, 9))),
d2 AS (SELECT a.kmer FROM n a WHERE substring(a.kmer, 1, 9) NOT IN (SELECT substring(kmer, 2) FROM n) AND a.n * 2.0 <= (SELECT max(b.n) FROM n b WHERE substring(b.kmer, 2) = substring(a.kmer, 2))) SELECT kmer, n FROM n WHERE kmer NOT IN (SELECT kmer FROM d1 UNION SELECT kmer FROM d2)""")
def shave_dead_ends(t):
    counted = P.counts(reads(t), "bases", 10).select(S.unpacked_kmer(F.col("key"), 10).alias("kmer"), "n")
    return C.shave(counted, 10)


@query(f"WITH {COUNTED} SELECT kmer, n FROM (SELECT *, max(n) OVER (PARTITION BY substring(kmer, 1, 9)) AS deep FROM n) WHERE n = deep OR n * 2.0 > deep")
def pop_bubbles(t):
    return C.pop_bubbles(P.counts(reads(t), "bases", 10).select(S.unpacked_kmer(F.col("key"), 10).alias("kmer"), "n"), 10)


@query("""WITH p AS (SELECT a.l_suppkey AS x, b.l_suppkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber), c AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p WHERE x <> y GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT a AS x, b AS y, n FROM c UNION ALL SELECT b, a, n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS k FROM w) SELECT f.x AS a, f.y AS b, f.n FROM r f JOIN r g ON f.x = g.y AND f.y = g.x WHERE f.k = 1 AND g.k = 1 AND f.x < f.y""")
def scaffold_links(t):
    """Suppliers that follow each other in orders, as contigs that mates link."""
    a = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x"))
    b = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("y"))
    return C.scaffold_links(a.join(b, ["l_orderkey", "l_linenumber"]), "x", "y", 2)


@query(f"WITH {WORDS}, k AS (SELECT DISTINCT id, kmer FROM {gram_sql(4)}), s AS (SELECT id, count(*) AS size FROM k GROUP BY id) SELECT a.id AS a, b.id AS b, round(count(*) / max(size), 9) AS share FROM k a JOIN k b ON a.kmer = b.kmer AND a.id <> b.id JOIN s ON s.id = a.id GROUP BY 1, 2 HAVING count(*) / max(size) >= 0.9")
def containments(t):
    out = C.containments(words(t).select("id", gram_hashes(4).alias("runs")), "id", "runs", 0.9)
    return out.select("a", "b", F.round("share", 9).alias("share"))


@query()
def greedy_clusters(t):
    """Documents that share nine tenths of their word runs with a longer one join it; tested against going through them one by one."""
    return C.set_clusters(words(t).select("id", gram_hashes(4).alias("runs"), (-F.size("w")).alias("rank")), "id", "runs", "rank", 0.9)


SPECTRA = f"{READS}, k AS {kmer_sql(2)}, a AS (SELECT x || y AS kmer, CAST((CASE WHEN x IN ('C', 'G') THEN 1 ELSE 0 END + CASE WHEN y IN ('C', 'G') THEN 1 ELSE 0 END) / 2 AS DOUBLE) AS g FROM (SELECT unnest(['A','C','G','T']) AS x), (SELECT unnest(['A','C','G','T']) AS y))"


@query(f"""WITH {SPECTRA}, c AS (SELECT id, kmer, count(*) AS n FROM k GROUP BY 1, 2), s AS (SELECT DISTINCT id FROM c), f AS (SELECT s.id, a.kmer, g, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.id) AS v FROM s CROSS JOIN a LEFT JOIN c ON c.id = s.id AND c.kmer = a.kmer),
cs AS (SELECT source, kmer, count(*) AS n FROM k JOIN reads USING (id) GROUP BY 1, 2), ss AS (SELECT DISTINCT source FROM cs), fs AS (SELECT ss.source, a.kmer, g, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY ss.source) AS v FROM ss CROSS JOIN a LEFT JOIN cs ON cs.source = ss.source AND cs.kmer = a.kmer),
d AS (SELECT f.id, fs.source, sum(abs(f.v - fs.v)) AS distance FROM f JOIN fs USING (kmer) GROUP BY 1, 2 HAVING abs(sum(f.v * f.g) - sum(fs.v * fs.g)) <= 0.05)
SELECT id, source, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), source) AS r FROM d) WHERE r = 1""")
def clade_classification(t):
    """Each document's nearest source by spectrum, among those of about its GC."""
    r = reads(t)
    refs = C.spectra(P.counts(r, "bases", 2, by="source"), "source", 2)
    own = C.spectra(P.of_reads(r, "id", "bases", 2), "id", 2)
    return C.nearest_spectra(own, refs, "id", "source", 0.05).select("id", "source", F.round("distance", 6).alias("distance"))


@query()
def frequency_clusters(t):
    """k-means over the documents' spectra; rows only."""
    return C.frequency_clusters(C.spectra(P.of_reads(reads(t), "id", "bases", 2), "id", 2), "id", "f", 4)


@query()
def metagenome_bins(t):
    """Sources by spectrum, GC and depth, by chains; tested against all pairs."""
    r = reads(t)
    depth = r.groupBy("source").agg(F.avg(F.length("bases")).alias("depth"))
    return C.bins(C.spectra(P.counts(r, "bases", 2, by="source"), "source", 2).join(depth, "source"), "source", "f", "depth", 0.02, 1.5)


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def all_pairs(t):
    return C.all_pairs(t("nation"), "n_nationkey", "n_name", F.levenshtein, block=10)


@query(f"WITH {READS}, k AS (SELECT (i - 1) % 3 AS frame, substring(bases, i, 3) AS kmer FROM (SELECT bases, unnest(range(1, len(bases) - 1)) AS i FROM reads)), c AS (SELECT CAST(frame AS INTEGER) AS frame, kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]*') GROUP BY 1, 2) SELECT frame, kmer, n, round(n / sum(n) OVER (PARTITION BY frame), 9) AS share FROM c")
def gene_model_counts(t):
    return C.frame_counts(reads(t), "bases", 3).withColumn("share", F.round("share", 9))


VARIANTS = "v AS (SELECT p_size % 3 AS scaf, p_partkey * 5 AS pos, repeat('A', 1 + p_partkey % 3) AS ref, repeat('C', 1 + p_size % 4) AS alt FROM part)"


@query(f"WITH {VARIANTS} SELECT scaf, CAST(pos + coalesce(sum(len(alt) - len(ref)) OVER (PARTITION BY scaf ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, alt AS ref, ref AS alt FROM v")
def invert_variants(t):
    v = t("part").select((F.col("p_size") % 3).alias("scaf"), (F.col("p_partkey") * 5).alias("pos"), F.repeat(F.lit("A"), (1 + F.col("p_partkey") % 3).cast("int")).alias("ref"), F.repeat(F.lit("C"), (1 + F.col("p_size") % 4).cast("int")).alias("alt"))
    return C.inverted_variants(v)


@query("SELECT p_partkey, substring(p_name, 1, 1) || '#' || substring(p_name, 3) AS bases, 1 AS applied FROM part")
def apply_variants(t):
    """Part names with a symbol changed."""
    p = t("part").select("p_partkey", F.col("p_name").alias("bases"))
    v = t("part").select("p_partkey", F.lit(2).alias("pos"), F.substring("p_name", 2, 1).alias("ref"), F.lit("#").alias("alt"), F.lit(5).cast("long").alias("depth"))
    return G.apply_variants(p, v, "p_partkey", "bases")


@query(f"WITH {WORDS}, {BENCH}, k AS {gram_sql(8)}, r AS (SELECT id AS item, kmer FROM {gram_sql(8, 'bench')}) SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item FROM r JOIN k USING (kmer))")
def unmatched_references(t):
    refs = bench_words(t).select("id", F.explode(gram_hashes(8)).alias("kmer"))
    found = words(t).select(F.explode(gram_hashes(8)).alias("kmer")).join(refs.select("kmer").distinct(), "kmer", "left_semi").distinct()
    hit = refs.join(found, "kmer", "left_semi").select("id").distinct()
    return t("benchmark").select(F.col("item_id")).join(hit, F.col("item_id") == F.col("id"), "left_anti")


@query("WITH n AS (SELECT p_name AS name, p_partkey AS value FROM part WHERE p_size > 10 QUALIFY count(*) OVER (PARTITION BY p_name) = 1), s AS (SELECT split_part(name, ' ', 1) AS s, min(value) AS v FROM n GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, coalesce(n.value, s.v) AS value FROM part p LEFT JOIN n ON n.name = p.p_name LEFT JOIN s ON s.s = split_part(p.p_name, ' ', 1)")
def name_lookup(t):
    """By the whole name, else by its first word where one name alone has it."""
    p = t("part")
    names = p.filter("p_size > 10").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("k"), F.min("p_partkey").alias("value")).filter("k = 1").drop("k")
    return T.lookup(p.select("p_partkey", "p_name"), names, "p_name", F.substring_index("p_name", " ", 1)).select("p_partkey", "value")


AMINO = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in zip(S._CODONS, S.CODE, strict=True)) + "}"


@query(f"WITH {READS} SELECT id, CAST(f AS INTEGER) AS frame, array_to_string(list_transform(range(f % 3 + 1, len(b) - 1, 3), lambda i: coalesce({AMINO}[substring(b, i, 3)], 'X')), '') AS amino FROM (SELECT id, f, CASE WHEN f < 3 THEN bases ELSE reverse(translate(bases, 'ACGT', 'TGCA')) END AS b FROM reads, (SELECT unnest(range(6)) AS f))")
def translate_six_frames(t):
    """Amino acids of all six frames."""
    return G.six_frames(reads(t), "id", "bases")


@query(f"""WITH {READS}, {BENCH_READS}, q AS (SELECT id, f, array_to_string(list_transform(range(f % 3 + 1, len(b) - 1, 3), lambda i: coalesce({AMINO}[substring(b, i, 3)], 'X')), '') AS p FROM (SELECT id, f, CASE WHEN f < 3 THEN bases ELSE reverse(translate(bases, 'ACGT', 'TGCA')) END AS b FROM reads, (SELECT unnest(range(6)) AS f))),
r AS (SELECT id AS ref, array_to_string(list_transform(range(1, len(bases) - 1, 3), lambda i: coalesce({AMINO}[substring(bases, i, 3)], 'X')), '') AS p FROM br),
qk AS (SELECT DISTINCT id, substring(p, i, 3) AS kmer FROM (SELECT id, p, unnest(range(1, len(p) - 1)) AS i FROM q) WHERE substring(p, i, 3) NOT LIKE '%X%'), rk AS (SELECT DISTINCT ref, substring(p, i, 3) AS kmer FROM (SELECT ref, p, unnest(range(1, len(p) - 1)) AS i FROM r) WHERE substring(p, i, 3) NOT LIKE '%X%'),
h AS (SELECT id, ref, count(*) AS hits FROM qk JOIN rk USING (kmer) GROUP BY 1, 2) SELECT id, ref, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, ref) AS k FROM h) WHERE k = 1 AND hits >= 1""")
def protein_search(t):
    """Documents against benchmark, both translated: the reference with most shared runs of three amino acids."""
    one = lambda r: r.groupBy("id").agg(F.array_join(F.collect_list("bases"), "N").alias("bases"))  # noqa: E731 - rows of one id, parted by what is in no codon
    own = G.protein_words(one(reads(t)), "id", "bases", 3)
    refs = G.protein_words(bench_reads(t), "id", "bases", 3, six=False).select(F.col("id").alias("ref"), "word").distinct()
    hits = own.join(refs, "word").groupBy("id", "ref").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy("id").agg(F.min(F.struct((-F.col("hits")).alias("m"), "ref")).alias("b"))
    return best.select("id", F.col("b.ref").alias("ref"), (-F.col("b.m")).alias("hits")).filter("hits >= 1")


@query()
def network_training(t):
    """A network trained on line items; accuracy on what it was trained on, rows only."""
    li = t("lineitem").withColumn("y", (F.col("l_discount") > 0.05).cast("int"))
    model, ready = C.trained_network(li, [F.col("l_discount") * 10, F.col("l_tax") * 10], "y", [2, 4, 2])
    return model.transform(ready).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query()
def spectra_tree(t):
    """A tree of sources by the distance of their spectra, in Newick form; tested against plain average linkage."""
    s = C.spectra(P.counts(reads(t), "bases", 2, by="source"), "source", 2)
    scored = C.all_pairs(s, "source", "f", lambda x, y: S.distance(x, y, "absolute"))
    rows = [(r.a, r.b, r.score) for r in scored.collect()]  # newick bounds the leaves
    return s.sparkSession.createDataFrame(pd.DataFrame({"tree": [C.newick(rows)]}), "tree string")
