"""K-mer joins, counts, sketches, duplicates and graphs over documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import aggregates as A
from seqloom.operators import graphs as G
from seqloom.operators import kmers as K
from seqloom.operators import packed as P
from seqloom.operators import sets as T
from seqloom.plans.registry import READS, WORDS, kmer_sql, query, reads, words

K8 = f"WITH {READS}, k AS {kmer_sql(8)}"


def k8(column: str = "bases"):
    return S.defined_kmers(F.col(column), 8)


def named(counted, k: int):
    """Counts of packed k-mers with their strings."""
    return counted.select(S.unpacked_kmer(F.col("key"), k).alias("kmer"), "n")


def runs_of(n: int, made):
    """``made`` of each run of n words. Words are taken by place: a slice inside a lambda copies the whole array, so long texts took the square of their words."""
    def all_of(w):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: made(F.array(*[F.get(w, i + j) for j in range(n)])))

    return S.let(F.col("w"), all_of)


def grams(n: int):
    """Runs of n words, joined by spaces."""
    return runs_of(n, lambda run: F.array_join(run, " "))


def gram_hashes(n: int):
    """64-bit hashes of runs of n words: what is shuffled is a number, not the words."""
    return runs_of(n, F.xxhash64)


def gram_sql(n: int, source: str = "words") -> str:
    return f"(SELECT id, i - 1 AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS kmer FROM (SELECT id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {source}))"


BENCH = "bench AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda x: x <> '') AS w FROM benchmark)"


def bench_words(t):
    return t("benchmark").select(F.col("item_id").alias("id"), F.filter(F.split(F.lower("text"), "[ \\t\\n]+"), lambda x: x != "").alias("w"))


@query(f"{K8} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count_exact(t):
    return named(P.counts(reads(t), "bases", 8), 8)


@query(f"{K8} SELECT greatest(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 5")
def kmer_count_canonical(t):
    return named(P.counts(reads(t), "bases", 8, canonical=True, least=5), 8)


@query(f"WITH {READS}, k AS {kmer_sql(3)} SELECT id, count(*) AS n, count(DISTINCT kmer) AS distinct_kmers FROM k GROUP BY id")
def kmer_count_short(t):
    return P.of_reads(reads(t), "id", "bases", 3).groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_kmers"))


@query(f"WITH {READS}, k AS {kmer_sql(40)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer HAVING count(*) >= 3")
def kmer_count_long(t):
    return K.counts(reads(t), S.defined_kmers(F.col("bases"), 40), least=3)


@query(f"{K8}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT n AS depth, count(*) AS unique_kmers, CAST(sum(n) AS BIGINT) AS raw_kmers FROM c GROUP BY n")
def kmer_histogram(t):
    return K.histogram(P.counts(reads(t), "bases", 8))


@query(f"""WITH {READS}, k AS {kmer_sql(8)}, a AS (SELECT kmer, count(*) AS n FROM k WHERE id % 2 = 0 GROUP BY kmer), b AS (SELECT kmer, count(*) AS n FROM k WHERE id % 2 = 1 GROUP BY kmer)
SELECT a.n AS depth_a, b.n AS depth_b, count(*) AS kmers FROM a JOIN b USING (kmer) GROUP BY 1, 2""")
def kmer_histogram_2d(t):
    r = reads(t)
    a, b = (P.counts(r.filter(f"id % 2 = {i}"), "bases", 8).withColumnRenamed("key", "kmer") for i in range(2))
    return K.two_depths(a, b)


@query(f"{K8} SELECT DISTINCT CAST(list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('ACGT', kmer[i]) - 1 AS BIGINT)), lambda a, b: a * 4 + b) AS BIGINT) AS key, kmer FROM k")
def kmer_pack(t):
    one = reads(t).select(F.explode(k8()).alias("kmer")).distinct()
    return one.select(S.packed_kmer(F.col("kmer")).alias("key"), "kmer").withColumn("kmer", S.unpacked_kmer(F.col("key"), 8))


@query(f"WITH {WORDS}, {BENCH}, k AS {gram_sql(8)}, r AS (SELECT kmer, min(id) AS ref FROM {gram_sql(8, 'bench')} GROUP BY kmer) SELECT k.id, count(*) AS hits FROM k JOIN r USING (kmer) GROUP BY k.id HAVING count(*) >= 2")
def kmer_filter_join(t):
    return K.matched_reads(words(t), "id", grams(8), K.reference_index(bench_words(t), "id", grams(8)), 2)


@query(f"WITH {WORDS}, {BENCH}, k AS {gram_sql(8)}, r AS (SELECT kmer, min(id) AS ref FROM {gram_sql(8, 'bench')} GROUP BY kmer) SELECT id FROM words WHERE id NOT IN (SELECT k.id FROM k JOIN r USING (kmer))")
def kmer_filter_unmatched(t):
    w = words(t)
    return w.select("id").join(K.matched_reads(w, "id", grams(8), K.reference_index(bench_words(t), "id", grams(8))), "id", "left_anti")


@query(f"""WITH {WORDS}, {BENCH}, k AS {gram_sql(8)}, r AS (SELECT kmer, min(id) AS ref FROM {gram_sql(8, 'bench')} GROUP BY kmer), h AS (SELECT k.id, ref AS ref_id, count(*) AS hits FROM k JOIN r USING (kmer) GROUP BY 1, 2)
SELECT id, ref_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, ref_id) AS n FROM h) WHERE n = 1""")
def kmer_best_reference(t):
    return K.best_reference(K.hits(words(t), "id", grams(8), K.reference_index(bench_words(t), "id", grams(8))), "id")


@query(f"""WITH {WORDS}, {BENCH}, k AS {gram_sql(3)}, r AS (SELECT kmer, min(id) AS ref FROM {gram_sql(3, 'bench')} GROUP BY kmer), h AS (SELECT k.id, ref AS ref_id, count(*) AS hits FROM k JOIN r USING (kmer) GROUP BY 1, 2)
SELECT id, ref_id, hits FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY hits DESC) AS n FROM h) WHERE n = 1""")
def kmer_best_reference_all(t):
    return K.best_reference(K.hits(words(t), "id", grams(3), K.reference_index(bench_words(t), "id", grams(3))), "id", "all")


@query(f"""WITH {WORDS}, {BENCH}, k AS {gram_sql(3)}, r AS (SELECT kmer, min(id) AS ref FROM {gram_sql(3, 'bench')} GROUP BY kmer), h AS (SELECT k.id, ref AS ref_id, count(*) AS hits FROM k JOIN r USING (kmer) GROUP BY 1, 2), x AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY hits DESC) AS n FROM h)
SELECT id, any_value(ref_id) AS ref_id, any_value(hits) AS hits FROM x WHERE n = 1 GROUP BY id HAVING count(*) = 1""")
def kmer_best_reference_toss(t):
    return K.best_reference(K.hits(words(t), "id", grams(3), K.reference_index(bench_words(t), "id", grams(3))), "id", "toss")


@query(f"WITH {WORDS}, {BENCH}, k AS {gram_sql(5)}, r AS (SELECT DISTINCT kmer FROM {gram_sql(5, 'bench')}) SELECT id, min(pos) AS start, max(pos) + 5 AS stop FROM k JOIN r USING (kmer) GROUP BY id")
def kmer_matched_span(t):
    out = K.matched_span(K.hits(words(t), "id", grams(5), K.reference_index(bench_words(t), "id", grams(5))), "id", 5)
    return out.select("id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(f"WITH {WORDS}, {BENCH}, k AS {gram_sql(5)}, r AS (SELECT DISTINCT kmer FROM {gram_sql(5, 'bench')}), h AS (SELECT id, unnest(range(pos, pos + 5)) AS p FROM k JOIN r USING (kmer)) SELECT id, count(DISTINCT p) AS covered FROM h GROUP BY id")
def kmer_covered_bases(t):
    return K.covered_bases(K.hits(words(t), "id", grams(5), K.reference_index(bench_words(t), "id", grams(5))), "id", 5)


BENCH_READS = """br AS (SELECT item_id AS id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS bases FROM benchmark WHERE text IS NOT NULL)"""


def bench_reads(t):
    return t("benchmark").filter("text is not null").select(F.col("item_id").alias("id"), S.once(F.regexp_replace(F.upper("text"), "[^ACGTN]", "")).alias("bases"))


@query(f"""WITH {READS}, {BENCH_READS}, ref AS (SELECT kmer, min(id) AS ref_id FROM {kmer_sql(10, 'br')} GROUP BY kmer),
m AS (SELECT ref_id, substring(kmer, 1, i - 1) || a || substring(kmer, i + 1) AS kmer FROM (SELECT kmer, ref_id, unnest(range(1, 11)) AS i FROM ref) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS a)), x AS (SELECT kmer, min(ref_id) AS ref_id FROM m GROUP BY kmer)
SELECT k.id, count(*) AS hits FROM {kmer_sql(10)} k JOIN x USING (kmer) GROUP BY k.id HAVING count(*) >= 3""")
def kmer_hamming_join(t):
    """Reference k-mers of all of benchmark, and all one substitution away."""
    index = K.reference_index(bench_reads(t), "id", S.defined_kmers(F.col("bases"), 10)).select("ref_id", F.explode(K.mutants(F.col("kmer"))).alias("kmer")).groupBy("kmer").agg(F.min("ref_id").alias("ref_id"))
    packed = index.select(S.packed_kmer(F.col("kmer")).alias("key"))
    return P.of_reads(reads(t), "id", "bases", 10).join(packed, "key").groupBy("id").agg(F.sum("n").alias("hits")).filter("hits >= 3")


@query(f"{K8}, f AS (SELECT kmer, min(id) AS first FROM k GROUP BY kmer) SELECT CAST(floor(first / 100.0) AS BIGINT) AS bin, count(*) AS fresh FROM f GROUP BY 1")
def uniqueness_curve(t):
    return P.of_reads(reads(t), "id", "bases", 8).groupBy("key").agg(F.min("id").alias("first")).groupBy(F.floor(F.col("first") / 100.0).alias("bin")).agg(F.count(F.lit(1)).alias("fresh"))


@query(f"{K8}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), o AS (SELECT id, list_sort(list(n)) AS a FROM k JOIN c USING (kmer) GROUP BY id) SELECT id, a[CAST(floor((len(a) + 1) / 2) AS BIGINT)] AS depth FROM o")
def read_depth(t):
    r = reads(t)
    return P.read_depth(P.of_reads(r, "id", "bases", 8), "id", P.counts(r, "bases", 8))


@query(f"{K8}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), o AS (SELECT id, list_sort(list(n)) AS a FROM k JOIN c USING (kmer) GROUP BY id), d AS (SELECT id, a[CAST(floor((len(a) + 1) / 2) AS BIGINT)] AS depth FROM o) SELECT id, depth FROM d WHERE depth >= 3 AND ((id * 7919) % 1000) / 1000.0 < 20.0 / depth")
def normalise_depth(t):
    r = reads(t)
    depth = P.read_depth(P.of_reads(r, "id", "bases", 8), "id", P.counts(r, "bases", 8))
    return K.normalise(r, "id", depth, 20, 3, ((F.col("id") * 7919) % 1000) / 1000.0).select("id", "depth")


@query(f"WITH {WORDS}, k AS {gram_sql(4)} SELECT kmer, count(DISTINCT source) AS groups FROM k JOIN words USING (id) GROUP BY kmer HAVING count(DISTINCT source) >= 4")
def widespread_kmers(t):
    return K.widespread(words(t), "source", grams(4), 4, gram_hashes(4))


@query(f"WITH {WORDS}, k AS {gram_sql(6)}, u AS (SELECT DISTINCT source, kmer FROM k JOIN words USING (id)) SELECT a.source AS q, b.source AS r, count(*) AS hits FROM u a JOIN u b ON a.kmer = b.kmer AND a.source < b.source GROUP BY 1, 2")
def inverted_index_join(t):
    own = words(t).select("source", F.explode(gram_hashes(6)).alias("line"))
    return T.shared_counts(own, "source", "line").select(F.col("a").alias("q"), F.col("b").alias("r"), F.col("shared").alias("hits"))


SKETCH = f"WITH {READS}, u AS (SELECT source, kmer FROM {kmer_sql(16)} k JOIN reads USING (id) GROUP BY 1, 2), s AS (SELECT source, key FROM (SELECT source, CAST('0x' || substring(md5(kmer), 1, 15) AS BIGINT) AS key, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substring(md5(kmer), 1, 15) AS BIGINT)) AS r FROM u) WHERE r <= 500), z AS (SELECT source, count(*) AS size FROM s GROUP BY 1)"


@query(SKETCH + " SELECT a.source AS q, b.source AS r, count(*) AS hits, round(count(*) / least(max(x.size), max(y.size)), 9) AS wkid, round(pow(count(*) / least(max(x.size), max(y.size)), 1 / 16.0), 9) AS ani FROM s a JOIN s b USING (key) JOIN z x ON x.source = a.source JOIN z y ON y.source = b.source GROUP BY 1, 2")
def sketch_compare(t):
    """Bottom-500 sketches of sources against each other."""
    made = K.sketch(reads(t), "source", S.defined_kmers(F.col("bases"), 16), 500)
    out = K.compare_sketches(made, made, "source", 500)
    return out.withColumn("ani", F.round(S.ani_from_kmer_identity(F.col("wkid"), 16), 9)).withColumn("wkid", F.round("wkid", 9))


@query()
def approximate_distinct(t):
    """HyperLogLog sketches by source, merged to one estimate of all; within the sketch's error of the exact count."""
    one = P.counts(reads(t), "bases", 8, by="source").groupBy("source").agg(F.hll_sketch_agg("key").alias("s"), F.sum("n").alias("n"))
    return one.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimate"), F.sum("n").alias("kmers"))


@query(f"{K8} SELECT 8 AS k, count(DISTINCT kmer) AS kmers FROM k UNION ALL SELECT 5, count(DISTINCT kmer) FROM {kmer_sql(5)}")
def multi_k_cardinality(t):
    r = reads(t)
    both = P.counts(r, "bases", 8).select(F.lit(8).alias("k")).union(P.counts(r, "bases", 5).select(F.lit(5)))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("kmers"))


@query("SELECT text, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_counts(t):
    return t("documents").groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS INTEGER) AS copy, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_flags(t):
    return A.duplicates(t("documents").select("doc_id", "text"), F.md5("text"), 1, F.col("doc_id")).select("doc_id", "copy", "duplicate")


@query(f"WITH {READS} SELECT min(id) AS id, greatest(bases, reverse(translate(bases, 'ACGT', 'TGCA'))) AS key FROM reads GROUP BY 2")
def dedupe_canonical(t):
    return reads(t).groupBy(S.canonical(F.col("bases")).alias("key")).agg(F.min("id").alias("id"))


@query(f"""WITH RECURSIVE {WORDS}, k AS {gram_sql(12)}, m AS (SELECT kmer, min(id) AS low FROM k GROUP BY kmer HAVING count(DISTINCT id) > 1), e AS (SELECT DISTINCT k.id AS a, m.low AS b FROM k JOIN m USING (kmer) WHERE k.id <> m.low), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, to_node) AS (SELECT a, b FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.to_node = s.a) SELECT node, least(node, min(to_node)) AS component FROM r GROUP BY node""")
def overlap_clusters(t):
    """Documents that share a run of twelve words, by chains; runs are compared by 64-bit hashes."""
    k = words(t).select("id", F.explode(F.array_distinct(gram_hashes(12))).alias("kmer"))
    low = k.withColumn("low", F.min("id").over(W.partitionBy("kmer")))  # one shuffle of the runs, not one for the least ids and one to join them
    return G.connected_components(low.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), "a", "b")


@query()
def assemble_unitigs(t):
    """Maximal unbranched paths of 21-mers seen at least three times; tested against a plain walk."""
    return G.unitigs(K.counts(reads(t), S.defined_kmers(F.col("bases"), 21), least=3), 21).withColumn("depth", F.round("depth", 6))


@query(f"WITH {READS}, p AS (SELECT id, arg_min(kmer, md5(kmer)) AS least FROM {kmer_sql(12)} GROUP BY id) SELECT id, least AS \"pivot\" FROM reads LEFT JOIN p USING (id)")
def clump_by_pivot(t):
    """Reads put next to each other by their least-hashed k-mer."""
    return reads(t).withColumn("pivot", K.pivot_kmer(S.defined_kmers(F.col("bases"), 12))).repartition("pivot").sortWithinPartitions("pivot", "id").select("id", "pivot")


@query()
def covering_set(t):
    """Sources that together hold every frequent word pair, greedily; tested against a plain loop."""
    own = words(t).select("source", F.explode(gram_hashes(2)).alias("pair")).groupBy("source", "pair").agg(F.count(F.lit(1)).alias("n"))
    members = own.withColumn("n", F.sum("n").over(W.partitionBy("pair"))).filter("n >= 50").select("source", "pair")
    chosen = G.greedy_cover(members, "source", "pair")
    return members.sparkSession.createDataFrame([(i, s) for i, s in enumerate(chosen)], "step int, source string")
