"""Orders, samples, approximate counts and their exact completions, scalars and symbol edits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import scalars as X
from seqloom.functions import sequence as S
from seqloom.operators import counting as N
from seqloom.operators import orders as O
from seqloom.operators import packed as P
from seqloom.operators import rows as R
from seqloom.operators import sets as T
from seqloom.plans.registry import QUALS, READS, kmer_sql, query, quals, reads


def h(key: str, seed: int = 0) -> str:
    return f"CAST('0x' || substring(md5(CAST({key} AS VARCHAR) || '-{seed}'), 1, 8) AS BIGINT)"


def place(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) - 1 AS place"


@query(f"SELECT page_id, {place('url, page_id')} FROM pages")
def order_by_name(t):
    return R.numbered(t("pages").select("page_id", "url"), [F.col("url"), F.col("page_id")], "place").select("page_id", "place")


@query("SELECT c_custkey, row_number() OVER (ORDER BY regexp_extract(c_name, '^(.*?)\\d*$', 1), coalesce(try_cast(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT), -1), c_name) - 1 AS place FROM customer")
def order_by_number_in_name(t):
    return R.numbered(t("customer").select("c_custkey", "c_name"), O.natural(F.col("c_name")), "place").select("c_custkey", "place")


@query(f"WITH {QUALS}, e AS (SELECT id, round(list_sum(list_transform(quals, lambda x: pow(10, -x / 10.0))) / len(quals), 9) AS rate FROM q) SELECT id, {place('rate, id')} FROM e")
def order_by_quality(t):
    rate = F.round(S.expected_errors(F.col("quals")) / F.size("quals"), 9)
    return R.numbered(quals(t).select("id", S.once(rate).alias("rate")), [F.col("rate"), F.col("id")], "place").select("id", "place")


@query(f"SELECT l_orderkey, l_linenumber, {place('l_suppkey, l_partkey, l_returnflag, l_orderkey, l_linenumber')} FROM lineitem")
def order_by_position(t):
    """Scaffold, place, strand."""
    return R.numbered(t("lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber"), [F.col(c) for c in ("l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")], "place").select("l_orderkey", "l_linenumber", "place")


@query(f"WITH {READS} SELECT id, {place('bases, id')} FROM reads")
def order_by_sequence(t):
    return R.numbered(reads(t).select("id", "bases"), [F.col("bases"), F.col("id")], "place").select("id", "place")


@query("WITH l AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS ordinal FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 20) SELECT doc_id, row_number() OVER (ORDER BY ordinal NULLS LAST, d.source NULLS FIRST, doc_id) - 1 AS place FROM documents d LEFT JOIN l USING (source)")
def order_by_list(t):
    d = t("documents").select("doc_id", "source")
    names = d.filter("source is not null").groupBy("source").count().filter("count > 20")
    listed = R.numbered(names, [F.col("count").desc(), F.col("source")], "ordinal").select(F.col("source").alias("name"), "ordinal")
    placed = d.join(listed, F.col("source") == F.col("name"), "left")
    return R.numbered(placed, [F.col("ordinal").asc_nulls_last(), F.col("source").asc_nulls_first(), F.col("doc_id")], "place").select("doc_id", "place")


@query("SELECT kind, id, row_number() OVER (ORDER BY bal, kind, id) - 1 AS place FROM (SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier)")
def merge_sorted(t):
    a = t("customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")).orderBy("bal")
    b = t("supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")).orderBy("bal")
    return O.merged([a, b], [F.col("bal"), F.col("kind"), F.col("id")]).select("kind", "id", "place")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {h('o_orderkey', 7)}, o_orderkey) - 1 AS place FROM orders")
def shuffle_rows(t):
    return O.shuffled(t("orders").select("o_orderkey"), F.col("o_orderkey"), 7).select("o_orderkey", "place")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {h("l_orderkey || '-' || l_linenumber")} % 1000000 < 100000")
def sample_by_hash(t):
    """About a tenth, the same rows each time."""
    return T.sample_rows(t("lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber"), 0.1).select("l_orderkey", "l_linenumber")


@query(f"SELECT doc_id FROM documents ORDER BY {h('doc_id')}, doc_id LIMIT 100")
def sample_exact(t):
    return T.exact_sample(t("documents").select("doc_id"), F.col("doc_id"), 100)


@query(f"SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY {h('doc_id', 3)}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents) WHERE s < 100000")
def sample_exact_bases(t):
    return O.sample_bases(t("documents").select("doc_id", "n_chars"), F.col("doc_id"), F.col("n_chars"), 100_000, 3).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents) WHERE s < 300000")
def sample_longest_first(t):
    return O.longest_first(t("documents").select("doc_id", "n_chars"), F.col("doc_id"), F.col("n_chars"), 300_000).select("doc_id")


@query(f"WITH n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT s_suppkey, row_number() OVER (ORDER BY {h('s_suppkey', 5)}, s_suppkey) - 1 AS p FROM supplier), m AS (SELECT s_suppkey, (1000 // n) + CASE WHEN p < 1000 % n THEN 1 ELSE 0 END AS times FROM p, n) SELECT s_suppkey, unnest(range(times)) AS copy FROM m")
def upsample(t):
    return O.upsample(t("supplier").select("s_suppkey"), F.col("s_suppkey"), 1000, 5).select("s_suppkey", F.col("copy").cast("long").alias("copy"))


@query("""SELECT o_orderkey, CAST(lag(o_totalprice) OVER w AS DOUBLE) AS before, CAST(lead(o_totalprice) OVER w AS DOUBLE) AS after, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS reached, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS kind FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def window_functions(t):
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    own = W.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t("orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.round(F.cume_dist().over(w), 9).alias("reached"), F.dense_rank().over(own).alias("kind"))


@query("SELECT CASE WHEN NOT (len(text) >= 200) THEN 'short' WHEN NOT (lang = 'en') THEN 'lang' WHEN NOT (source IS NOT NULL AND len(source) > 3) THEN 'source' ELSE 'kept' END AS filter, count(*) AS dropped, CAST(sum(n_chars) AS BIGINT) AS weight FROM documents GROUP BY 1")
def filter_counts(t):
    d = t("documents")
    return O.filter_counts(d, {"short": F.length("text") >= 200, "lang": F.col("lang") == "en", "source": F.length("source") > 3}, F.col("n_chars"))


RECAL = "m AS (SELECT l_linenumber AS q, l_returnflag AS f, count(*) AS total, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS wrong FROM lineitem GROUP BY 1, 2), x AS (SELECT q, f, CASE WHEN total >= 20 THEN greatest(CAST(round(-10 * log10((wrong + 1) / (total + 2))) AS INTEGER), 2) END AS quality FROM m)"


@query(f"WITH {RECAL} SELECT l_orderkey, l_linenumber, CAST(coalesce(quality, l_linenumber) AS INTEGER) AS q FROM lineitem LEFT JOIN x ON x.q = l_linenumber AND f = l_returnflag")
def quality_recalibration(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("int").alias("q"))
    matrix = O.quality_matrix(li, ["q", "l_returnflag"], F.col("l_linestatus") == "O", 20)
    return O.recalibrated(li, matrix, ["q", "l_returnflag"], "q").select("l_orderkey", "l_linenumber", "q")


# --- counts ---------------------------------------------------------------------

K8 = f"WITH {READS}, k AS {kmer_sql(8)}"


def keys(t, k: int = 8):
    return P.of_reads(reads(t), "id", "bases", k).select(S.unpacked_kmer(F.col("key"), k).alias("kmer"), "n")


@query(f"{K8}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), l AS (SELECT i, {h('kmer', 0)} % 4096 AS x0, {h('kmer', 1)} % 4096 AS x1, {h('kmer', 2)} % 4096 AS x2, kmer, n FROM c, (SELECT 0 AS i)), a AS (SELECT x0, sum(n) AS n FROM l GROUP BY 1), b AS (SELECT x1, sum(n) AS n FROM l GROUP BY 1), d AS (SELECT x2, sum(n) AS n FROM l GROUP BY 1) SELECT kmer, CAST(least(a.n, b.n, d.n) AS BIGINT) AS estimate FROM l JOIN a USING (x0) JOIN b USING (x1) JOIN d USING (x2)")
def count_min(t):
    """Estimates by three lines of 4096 cells; never below the true counts."""
    own = keys(t).groupBy("kmer").agg(F.sum("n").alias("n"))
    table = N.count_min(own, "kmer", 3, 4096, "n")
    return N.estimates(own, "kmer", table, 3, 4096)


@query("WITH w AS (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n]+')) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) >= 50")
def prefiltered_counts(t):
    """Frequent words, exactly, counted only where a table of cells is full enough."""
    w = t("documents").filter("text is not null").select(F.explode(F.split(F.lower("text"), "[ \\t\\n]+")).alias("word")).filter("word <> ''")
    return N.prefiltered_counts(w, "word", 50)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def bloom_semi_join(t):
    parts = t("part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return N.bloom_semi_join(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey").select("l_orderkey", "l_linenumber")


LOGLOG = f"""r AS (SELECT source, {h('kmer', 1)} % 256 AS bucket, max(33 - len(bin({h('kmer', 0)})) + CASE WHEN {h('kmer', 0)} = 0 THEN 1 ELSE 0 END) AS rank FROM k JOIN reads USING (id) GROUP BY 1, 2)"""
RAW = f"{0.7213 / (1 + 1.079 / 256) * 256 * 256!r}"


@query(f"{K8}, {LOGLOG}, e AS (SELECT source, sum(pow(2.0, -rank)) AS s, 256 - count(*) AS empty FROM r GROUP BY 1), x AS (SELECT source, {RAW} / (s + empty) AS raw, empty FROM e) SELECT source, round(CASE WHEN raw <= 640 AND empty > 0 THEN 256.0 * ln(256.0 / empty) ELSE raw END, 6) AS estimate FROM x")
def loglog_distinct(t):
    """Distinct 8-mers of each source from 256 registers."""
    own = P.counts(reads(t), "bases", 8, by="source").select("source", S.unpacked_kmer(F.col("key"), 8).alias("kmer"))
    return N.register_estimate(N.registers(own, "source", F.col("kmer")), "source").withColumn("estimate", F.round("estimate", 6))


@query(f"{K8}, {LOGLOG}, u AS (SELECT bucket, max(rank) AS rank FROM r GROUP BY 1), e AS (SELECT sum(pow(2.0, -rank)) AS s, 256 - count(*) AS empty FROM u), x AS (SELECT {RAW} / (s + empty) AS raw, empty FROM e) SELECT round(CASE WHEN raw <= 640 AND empty > 0 THEN 256.0 * ln(256.0 / empty) ELSE raw END, 6) AS estimate FROM x")
def loglog_merged(t):
    """The sources' registers put together."""
    own = P.counts(reads(t), "bases", 8, by="source").select("source", S.unpacked_kmer(F.col("key"), 8).alias("kmer"))
    return N.register_estimate(N.registers(own, "source", F.col("kmer")), None).withColumn("estimate", F.round("estimate", 6))


@query(f"WITH {READS}, k AS {kmer_sql(12)}, s AS (SELECT source, {h('kmer', 1)} % 128 AS bucket, min({h('kmer', 0)}) AS value FROM k JOIN reads USING (id) GROUP BY 1, 2) SELECT a.source AS q, b.source AS r, CAST(sum(CASE WHEN a.value = b.value THEN 1 ELSE 0 END) AS BIGINT) AS equal, count(*) AS both, round(sum(CASE WHEN a.value = b.value THEN 1 ELSE 0 END) / count(*), 9) AS similarity FROM s a JOIN s b USING (bucket) WHERE a.source < b.source GROUP BY 1, 2 HAVING sum(CASE WHEN a.value = b.value THEN 1 ELSE 0 END) > 0")
def bucket_sketch_compare(t):
    own = P.counts(reads(t), "bases", 12, by="source").select("source", S.unpacked_kmer(F.col("key"), 12).alias("kmer"))
    made = N.bucket_sketch(own, "source", F.col("kmer"))
    return N.compare_buckets(made, made, "source").withColumn("similarity", F.round("similarity", 9))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS deviation, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most FROM documents GROUP BY 1")
def merge_statistics(t):
    """Statistics by language put together to those of sources."""
    parts = N.partial_statistics(t("documents"), ["source", "lang"], "n_chars")
    out = N.merged_statistics([parts.drop("lang")], ["source"])
    return out.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 4)})


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def limit_depth(t):
    return N.limited(t("events").select("event_id", "user_id"), "user_id", 3, F.col("event_id")).select("event_id")


@query("WITH p AS (SELECT p_brand AS a, substring(p_type || p_brand, 1, len(p_brand)) AS b FROM part) SELECT CAST(i - 1 AS INTEGER) AS pos, a[i] AS \"from\", b[i] AS \"to\", count(*) AS n FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM p) GROUP BY 1, 2, 3")
def transition_matrix(t):
    p = t("part").select(F.col("p_brand").alias("a"), F.substring(F.concat("p_type", "p_brand"), F.lit(1), F.length("p_brand")).alias("b"))
    return N.transition_matrix(p, "a", "b")


GRID = "c AS (SELECT event_type, CAST(floor(user_id / 100) AS BIGINT) AS gx, CAST(floor(event_id / 1000) AS BIGINT) AS gy, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2, 3), z AS (SELECT *, (mean - avg(mean) OVER (PARTITION BY event_type)) / nullif(stddev_pop(mean) OVER (PARTITION BY event_type), 0) AS z FROM c)"


@query(f"WITH {GRID} SELECT event_type, gx, gy, n, round(mean, 6) AS mean, round(coalesce(z, 0), 6) AS z FROM z")
def tile_statistics(t):
    g = N.grid_statistics(t("events").withColumn("gy_of", F.col("event_id") / 10), ["event_type"], F.col("user_id"), F.col("gy_of"), 100, F.col("value"))
    return g.withColumns({"mean": F.round("mean", 6), "z": F.round("z", 6)})


@query(f"WITH {GRID} SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.event_type = e.event_type AND gx = floor(user_id / 100) AND gy = floor(event_id / 1000) AND z < -1)")
def tile_filter(t):
    e = t("events").withColumn("gy_of", F.col("event_id") / 10)
    bad = N.grid_statistics(e, ["event_type"], F.col("user_id"), F.col("gy_of"), 100, F.col("value")).filter("z < -1")
    return N.without_cells(e, bad, ["event_type"], F.col("user_id"), F.col("gy_of"), 100).select("event_id")


@query("WITH m AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 25), c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN (SELECT p_brand FROM m) GROUP BY 1, 2) SELECT l_suppkey, count(*) AS found, CAST(sum(n - 1) AS BIGINT) AS extra, round(count(*) / (SELECT count(*) FROM m), 9) AS completeness, round(sum(n - 1) / (SELECT count(*) FROM m), 9) AS contamination FROM c GROUP BY 1")
def marker_completeness(t):
    li = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    out = N.completeness(li, t("part").filter("p_size > 25").select("p_brand"), "l_suppkey", "p_brand", "n")
    return out.withColumns({c: F.round(c, 9) for c in ("completeness", "contamination")})


@query("WITH a AS (SELECT l_suppkey AS k, l_returnflag AS c, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, l_returnflag AS c, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2) SELECT count(*) AS cells, round(corr(x, y), 6) AS r FROM a JOIN b USING (k, c)")
def matrix_correlation_cells(t):
    """Two matrices, suppliers by flags, cell by cell."""
    made = lambda c: t("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(c))
    return N.matrix_correlation(made("l_quantity"), made("l_extendedprice"), "l_suppkey").withColumn("r", F.round("r", 6))


@query("WITH d AS (SELECT l_partkey AS contig, l_suppkey % 5 AS library, count(*) AS depth FROM lineitem GROUP BY 1, 2), m AS (SELECT contig, max(depth) AS top, max(CASE WHEN r = 1 THEN library END) AS source FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY depth DESC, library DESC) AS r FROM d) GROUP BY 1) SELECT contig, library, depth, source FROM d JOIN m USING (contig) WHERE library <> source AND depth * 4 < top")
def cross_contamination(t):
    d = t("lineitem").groupBy(F.col("l_partkey").alias("contig"), (F.col("l_suppkey") % 5).alias("library")).agg(F.count(F.lit(1)).alias("depth"))
    return N.cross_contamination(d, "contig", "library", "depth", 4)


@query("SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) AS n, CAST(grouping(n_regionkey) * 2 + grouping(c_mktsegment) AS BIGINT) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube_counts(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.cube(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


# --- scalars --------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(l), 6) AS total, round(list_sort(l)[1 + CAST(floor(0.9 * (len(l) - 1)) AS INTEGER)], 6) AS p90, round(list_reverse(l)[1], 6) AS last, len(list_distinct(list_transform(l, lambda x: floor(x * 10)))) AS levels FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)")
def array_algebra(t):
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    return v.select("vec_id", F.round(X.total(F.col("l")), 6).alias("total"), F.round(X.array_percentile(F.col("l"), 0.9), 6).alias("p90"), F.round(F.get(F.reverse("l"), F.lit(0)), 6).alias("last"), F.size(F.array_distinct(F.transform("l", lambda x: F.floor(x * 10)))).cast("long").alias("levels"))


@query("SELECT p_partkey, list_sum(n) AS total, len(n) - list_count(n) AS broken FROM (SELECT p_partkey, list_transform(string_split(CAST(p_retailprice AS VARCHAR) || ',' || p_size || ',x', ','), lambda x: try_cast(x AS DOUBLE)) AS n FROM part)")
def array_parsing(t):
    text = F.concat(F.col("p_retailprice").cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit(",x"))
    n = t("part").select("p_partkey", X.number_array(text).alias("n"))
    good = F.filter("n", lambda x: x.isNotNull())
    return n.select("p_partkey", X.total(good).alias("total"), (F.size("n") - F.size(good)).cast("long").alias("broken"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), 9) AS jaccard FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_algebra(t):
    p = t("part").select("p_partkey", F.split("p_name", " ").alias("w"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("v"))
    return p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.round(X.jaccard(F.col("w"), F.col("v")), 9).alias("jaccard"))


@query("SELECT doc_id, CAST(list_max(map_values(m)) AS INTEGER) AS most, CAST(len(map_keys(m)) AS INTEGER) AS letters FROM (SELECT doc_id, histogram(c) AS m FROM (SELECT doc_id, unnest(string_split(source, '')) AS c FROM documents WHERE source IS NOT NULL AND source <> '') GROUP BY doc_id)")
def map_counts(t):
    d = t("documents").filter("source is not null and source <> ''").select("doc_id", X.counts_map(F.filter(F.split("source", ""), lambda c: c != "")).alias("m"))
    return d.select("doc_id", F.array_max(F.map_values("m")).alias("most"), F.size("m").alias("letters"))


@query(f"WITH {READS}, k AS (SELECT DISTINCT kmer FROM {kmer_sql(8)}) SELECT kmer, CAST(list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('ACGT', reverse(translate(kmer, 'ACGT', 'TGCA'))[i]) - 1 AS BIGINT)), lambda a, b: a * 4 + b) AS BIGINT) AS back FROM k")
def packed_reverse_complement(t):
    one = P.counts(reads(t), "bases", 8)
    return one.select(S.unpacked_kmer(F.col("key"), 8).alias("kmer"), X.packed_reverse_complement(F.col("key"), 8).alias("back"))


ILLUMINA = "h AS (SELECT event_id, 'M' || user_id % 9 || ':' || user_id % 4 || ':' || event_type || ':' || 1 + event_id % 8 || ':' || 1101 + (event_id % 2) * 1000 || ':' || user_id || ':' || event_id % 977 || ' ' || 1 + event_id % 2 || ':' || CASE WHEN event_id % 10 = 0 THEN 'Y' ELSE 'N' END || ':0:ACGT' AS name FROM events)"


def _names(t):
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    name = F.concat(F.lit("M"), text(u % 9), F.lit(":"), text(u % 4), F.lit(":"), "event_type", F.lit(":"), text(1 + e % 8), F.lit(":"), text(1101 + (e % 2) * 1000), F.lit(":"), text(u), F.lit(":"), text(e % 977), F.lit(" "), text(1 + e % 2), F.lit(":"), F.when(e % 10 == 0, "Y").otherwise("N"), F.lit(":0:ACGT"))
    return t("events").select("event_id", name.alias("name"))


@query(f"WITH {ILLUMINA} SELECT event_id, split_part(name, ':', 3) AS flowcell, CAST(split_part(name, ':', 4) AS INTEGER) AS lane, CAST(split_part(name, ':', 5) AS INTEGER) AS tile, CAST(split_part(name, ':', 6) AS INTEGER) AS x, CAST(split_part(split_part(name, ' ', 2), ':', 1) AS INTEGER) AS pair, split_part(split_part(name, ' ', 2), ':', 2) = 'N' AS passed, CASE WHEN split_part(name, ':', 5)[1] = '1' THEN 'top' ELSE 'bottom' END AS surface FROM h")
def instrument_headers(t):
    n = _names(t).select("event_id", X.illumina_header(F.col("name")).alias("h"))
    return n.select("event_id", "h.flowcell", "h.lane", "h.tile", "h.x", "h.pair", "h.passed", X.tile_surface(F.col("h.tile")).alias("surface"))


@query(f"WITH {ILLUMINA} SELECT event_id FROM h WHERE split_part(split_part(name, ' ', 2), ':', 2) = 'N' AND CAST(split_part(name, ':', 4) AS INTEGER) BETWEEN 2 AND 5 AND split_part(name, ':', 5)[1] = '1'")
def header_flag_filter(t):
    """Passed reads of some lanes and one surface."""
    n = _names(t).withColumn("h", X.illumina_header(F.col("name")))
    return n.filter(F.col("h.passed") & F.col("h.lane").between(2, 5) & (X.tile_surface(F.col("h.tile")) == "top")).select("event_id")


@query("SELECT p_partkey, 'name=' || p_name || '%3B' || p_size || ';type=' || p_type || '%3Dx' AS encoded, p_name || ';' || p_size AS name FROM part")
def header_codec(t):
    p = t("part").select("p_partkey", X.encoded_fields({"name": F.concat("p_name", F.lit(";"), F.col("p_size").cast("string")), "type": F.concat("p_type", F.lit("=x"))}).alias("encoded"))
    return p.withColumn("name", X.decoded_field(F.col("encoded"), "name"))


@query("WITH b AS (SELECT l_partkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY 1) SELECT l_partkey, round(least(1.0, 2 * list_sum(list_transform(range(CAST(least(k, n - k) + 1 AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))), 6) AS p FROM b")
def strand_balance(t):
    b = t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("k"))
    return b.select("l_partkey", F.round(X.balance_probability(F.col("k"), F.col("n")), 6).alias("p"))


@query(f"WITH {READS} SELECT id, CAST(len(bases[51:]) - len(ltrim(bases[51:], bases[51])) + len(bases[:50]) - len(rtrim(bases[:50], bases[51])) AS INTEGER) AS run FROM reads WHERE len(bases) > 60")
def homopolymer_context(t):
    return reads(t).filter(F.length("bases") > 60).select("id", X.homopolymer_context(F.col("bases"), F.lit(50)).alias("run"))


@query("SELECT event_id, date_trunc('hour', ts) AS hour, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_seconds, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def date_functions(t):
    ts = F.col("ts").cast("timestamp_ntz")
    day = F.date_trunc("day", ts).cast("timestamp")
    return t("events").select("event_id", F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"), F.unix_timestamp(day).alias("day_seconds"), F.dayofyear(ts).alias("day_of_year"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"))


@query("SELECT o_orderkey, md5(o_orderstatus || o_custkey) AS h, sha256(CAST(o_orderkey AS VARCHAR)) AS s FROM orders")
def hash_functions(t):
    return t("orders").select("o_orderkey", F.md5(F.concat("o_orderstatus", F.col("o_custkey").cast("string"))).alias("h"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("s"))


@query("SELECT o_orderkey, coalesce(nullif(ltrim(array_to_string(list_transform(range(11, -1, -1), lambda i: chr(CAST(48 + ((o_orderkey * 7919 * 104729) // CAST(pow(48, i) AS HUGEINT)) % 48 AS INTEGER))), ''), '0'), ''), '0') AS code, o_orderkey * 7919 * 104729 AS back FROM orders")
def base48_codec(t):
    n = F.col("o_orderkey") * 7919 * 104729
    return t("orders").select("o_orderkey", X.encoded48(n).alias("code")).withColumn("back", X.decoded48(F.col("code")))


@query("SELECT p_partkey, CASE WHEN p_retailprice * 1000 >= 1e6 THEN format('{:.2f}', p_retailprice / 1000) || 'm' ELSE format('{:.2f}', p_retailprice) || 'k' END AS short, format('{:.2f}', 100 * p_size / 50.0) || '%' AS share FROM part WHERE p_retailprice >= 1")
def formatting(t):
    return t("part").filter("p_retailprice >= 1").select("p_partkey", X.short_number(F.col("p_retailprice") * 1000).alias("short"), X.percent(F.col("p_size"), F.lit(50.0)).alias("share"))


@query("SELECT p_partkey, greatest(least(p_size, 20), least(greatest(p_size, 20), 30)) AS mid, round(log2(p_size + 1), 9) AS bits, p_partkey >= 2 AND len(list_filter(range(2, CAST(floor(sqrt(p_partkey)) AS BIGINT) + 1), lambda d: p_partkey % d = 0)) = 0 AS prime FROM part")
def math_helpers(t):
    return t("part").select("p_partkey", X.middle(F.col("p_size"), F.lit(20), F.lit(30)).alias("mid"), F.round(F.log2(F.col("p_size") + 1), 9).alias("bits"), X.is_prime(F.col("p_partkey")).alias("prime"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first FROM events WHERE json_valid(props) AND len(json_keys(props)) > 0")
def json_scalars(t):
    e = t("events").select("event_id", "props", F.json_object_keys("props").alias("k")).filter("size(k) > 0")
    return e.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.get("k", F.lit(0))).alias("first"))


def frequencies(t):
    pairs = [a + b for a in "ACGT" for b in "ACGT"]
    own = P.counts(reads(t), "bases", 2, by="source").groupBy("source").pivot("key", list(range(16))).agg(F.sum("n")).na.fill(0)
    total = sum((F.col(f"`{i}`") for i in range(16)), F.lit(0))
    return own.select("source", F.array(*[F.col(f"`{i}`") / total for i in range(len(pairs))]).alias("f"))


@query(f"""WITH {READS}, k AS {kmer_sql(2)}, c AS (SELECT source, kmer, count(*) AS n FROM k JOIN reads USING (id) GROUP BY 1, 2), a AS (SELECT x || y AS kmer FROM (SELECT unnest(['A','C','G','T']) AS x), (SELECT unnest(['A','C','G','T']) AS y)), s AS (SELECT DISTINCT source FROM c),
f AS (SELECT s.source, a.kmer, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.source) AS v FROM s CROSS JOIN a LEFT JOIN c ON c.source = s.source AND c.kmer = a.kmer)
SELECT p.source AS a, q.source AS b, round(sum(abs(p.v - q.v)), 9) AS absolute, round(sqrt(sum((p.v - q.v) * (p.v - q.v))), 9) AS euclid, round(1 - sum(p.v * q.v) / sqrt(sum(p.v * p.v) * sum(q.v * q.v)), 9) AS cosine, round(sqrt(sum(pow(sqrt(p.v) - sqrt(q.v), 2)) / 2), 9) AS hellinger FROM f p JOIN f q USING (kmer) WHERE p.source < q.source GROUP BY 1, 2""")
def frequency_distances(t):
    f = frequencies(t)
    both = f.select(F.col("source").alias("a"), F.col("f").alias("x")).join(f.select(F.col("source").alias("b"), F.col("f").alias("y")), F.col("a") < F.col("b"))
    return both.select("a", "b", *[F.round(S.distance(F.col("x"), F.col("y"), kind), 9).alias(kind) for kind in ("absolute", "euclid", "cosine", "hellinger")])


TEXT = "t AS (SELECT doc_id, text AS x FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {TEXT} SELECT doc_id, md5(regexp_replace(x, '[^ACGTNacgtn]', 'N', 'g')) AS n, md5(translate(x, 'Uu', 'Tt')) AS t, md5(translate(x, 'AB', 'BA')) AS r, md5('NNN' || x || 'NN') AS p, md5(lower(x)) AS l FROM t")
def symbol_edits(t):
    x = F.col("text")
    return t("documents").filter("text is not null").select("doc_id", F.md5(X.iupac_to_n(x)).alias("n"), F.md5(X.u_to_t(x)).alias("t"), F.md5(X.remapped(x, "AB", "BA")).alias("r"), F.md5(X.padded(x, 3, 2)).alias("p"), F.md5(F.lower(x)).alias("l"))


@query("SELECT p_partkey, regexp_full_match(upper(p_brand), '[ACGTUNRYSWKMBDHV.\\-]*') = false AS junk, regexp_replace(p_name, '[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv.\\-]', 'N', 'g') AS fixed, regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9._:+|-]+', '_', 'g') AS header FROM part")
def junk_symbols(t):
    return t("part").select("p_partkey", X.is_junk(F.col("p_brand")).alias("junk"), X.without_junk(F.col("p_name")).alias("fixed"), X.clean_header(F.concat("p_name", F.lit(" "), "p_brand")).alias("header"))


@query(f"WITH {READS}, g AS (SELECT id, bases, len(regexp_extract(bases, '[T]+$')) AS tail, len(regexp_extract(bases, '^T+(?:[^T]?T+){{0,2}}')) AS head FROM reads) SELECT id, tail, head, substring(bases, CASE WHEN head >= 2 THEN head ELSE 0 END + 1) AS bases FROM g")
def polymer_trim(t):
    r = reads(t)
    return r.select("id", X.polymer_length(F.col("bases"), "T").cast("long").alias("tail"), X.polymer_length(F.col("bases"), "T", "head", 2).cast("long").alias("head"), X.trimmed_polymer(F.col("bases"), "T", 2, "head", 2).alias("bases"))
