"""Joins, aggregates, intervals, sets, orders and trees over the star schema, events, pages and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import aggregates as A
from seqloom.operators import graphs as G
from seqloom.operators import intervals as I
from seqloom.operators import rows as R
from seqloom.operators import sets as T
from seqloom.plans.registry import QUALS, READS, WORDS, quals, query, reads, words

DAY = "date_diff('day', DATE '1992-01-01', CAST({} AS DATE))"


def day(c: str):
    return F.datediff(F.to_date(c), F.lit("1992-01-01").cast("date"))


#: Days from order to last shipment, by customer: intervals on a line.
SPANS = f"spans AS (SELECT o_custkey AS scaf, {DAY.format('min(o_orderdate)')} AS start, {DAY.format('max(l_shipdate)')} + 1 AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey HAVING max(l_shipdate) >= min(o_orderdate))"


def spans(t):
    j = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("l_shipdate").alias("b")).filter("b >= a")
    return j.select(F.col("o_custkey").alias("scaf"), day("a").cast("long").alias("start"), (day("b") + 1).cast("long").alias("stop"))


MERGED = """m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY scaf ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY scaf ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


@query(f"WITH {SPANS}, {MERGED} SELECT scaf, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY scaf, run")
def interval_merge(t):
    return I.merge(spans(t), ["scaf"])


SEGMENTS = f"""WITH {SPANS}, ev AS (SELECT scaf, x, sum(d) AS d FROM (SELECT scaf, start AS x, 1 AS d FROM spans UNION ALL SELECT scaf, stop, -1 FROM spans) GROUP BY 1, 2 HAVING sum(d) <> 0),
seg AS (SELECT scaf, x AS start, lead(x) OVER (PARTITION BY scaf ORDER BY x) AS stop, CAST(sum(d) OVER (PARTITION BY scaf ORDER BY x) AS BIGINT) AS depth FROM ev)"""


@query(SEGMENTS + " SELECT * FROM seg WHERE stop IS NOT NULL")
def coverage_segments(t):
    return I.depth_segments(spans(t), ["scaf"])


@query(SEGMENTS + """, l AS (SELECT scaf, max(stop) AS length FROM spans GROUP BY scaf), s AS (SELECT scaf, CAST(sum((stop - start) * depth) AS BIGINT) AS bases, CAST(sum(stop - start) AS BIGINT) AS covered_bases, max(depth) AS max_depth FROM seg WHERE stop IS NOT NULL AND depth > 0 GROUP BY scaf)
SELECT scaf, length, round(bases / length, 9) AS avg_fold, covered_bases, round(100.0 * covered_bases / length, 9) AS covered_percent, max_depth FROM l JOIN s USING (scaf)""")
def coverage_stats(t):
    s = spans(t)
    out = I.coverage_stats(I.depth_segments(s, ["scaf"]), s.groupBy("scaf").agg(F.max("stop").alias("length")), "scaf", "length")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_fold", "covered_percent")})


@query(SEGMENTS + """, l AS (SELECT scaf, max(stop) AS length FROM spans GROUP BY scaf) SELECT depth, CAST(sum(stop - start) AS BIGINT) AS bases FROM seg WHERE stop IS NOT NULL AND depth > 0 GROUP BY depth
UNION ALL SELECT 0, CAST((SELECT sum(length) FROM l) - (SELECT sum(stop - start) FROM seg WHERE stop IS NOT NULL AND depth > 0) AS BIGINT)""")
def coverage_histogram(t):
    s = spans(t)
    return I.depth_histogram(I.depth_segments(s, ["scaf"]), s.groupBy("scaf").agg(F.max("stop").alias("length")), "scaf", "length")


def _days(mode: str, keep: str) -> str:
    return f"""WITH {SPANS}, a AS (SELECT DISTINCT scaf, unnest(range(start, stop)) AS d FROM spans WHERE start % 2 = 0), b AS (SELECT DISTINCT scaf, unnest(range(start, stop)) AS d FROM spans WHERE start % 2 = 1),
x AS ({keep}), y AS (SELECT scaf, d, d - row_number() OVER (PARTITION BY scaf ORDER BY d) AS run FROM x) SELECT scaf, min(d) AS start, max(d) + 1 AS stop FROM y GROUP BY scaf, run"""


def _halves(t):
    s = spans(t)
    return [s.filter("start % 2 = 0"), s.filter("start % 2 = 1")]


@query(_days("union", "SELECT * FROM a UNION SELECT * FROM b"))
def interval_union(t):
    return I.combine(_halves(t), ["scaf"], "union")


@query(_days("intersect", "SELECT * FROM a INTERSECT SELECT * FROM b"))
def interval_intersect(t):
    return I.combine(_halves(t), ["scaf"], "intersect")


@query(_days("subtract", "SELECT * FROM a EXCEPT SELECT * FROM b"))
def interval_subtract(t):
    return I.combine(_halves(t), ["scaf"], "subtract")


@query(f"WITH {SPANS}, p AS (SELECT o_orderkey, o_custkey, {DAY.format('o_orderdate')} AS x FROM orders) SELECT o_orderkey, count(*) AS n FROM p JOIN spans ON scaf = o_custkey AND x >= start AND x < stop GROUP BY 1")
def interval_membership(t):
    points = t("orders").select("o_orderkey", F.col("o_custkey").alias("scaf"), day("o_orderdate").cast("long").alias("at"))
    return I.within(points, spans(t), "scaf", "at", 64).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS (SELECT o_orderkey, o_custkey, {DAY.format('o_orderdate')} AS x FROM orders) SELECT a.o_orderkey, count(*) - 1 AS near FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND abs(a.x - b.x) <= 60 GROUP BY 1")
def nearby_rows(t):
    points = t("orders").select("o_orderkey", "o_custkey", day("o_orderdate").cast("long").alias("at"))
    return I.nearby(points, ["o_custkey"], "at", 60).select("o_orderkey", "near")


@query("SELECT event_id, round(mean, 9) AS mean FROM (SELECT event_id, avg(value) OVER w AS mean, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4 AND mean < 5")
def low_coverage_windows(t):
    return I.low_windows(t("events"), ["user_id"], "event_id", "value", 4, 5.0).select("event_id", F.round("mean", 9).alias("mean"))


@query("SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT event_id, user_id, epoch(ts) AS s, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600 THEN 0 ELSE 1 END AS fresh FROM events)")
def sessions(t):
    return I.sessions(t("events"), "user_id", F.col("ts").cast("timestamp").cast("double"), 3600.0).select("event_id", "session")


@query("SELECT a.event_id, (SELECT max_by(b.event_id, b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id <= a.event_id) AS last_purchase FROM events a WHERE a.event_type = 'click'")
def asof_join(t):
    e = t("events").select("user_id", "event_id", "event_type")
    right = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("last_purchase"))
    return I.asof(e.filter("event_type = 'click'").select("user_id", "event_id"), right, "user_id", "event_id", "last_purchase").select("event_id", "last_purchase")


@query("WITH h AS (SELECT CAST(l_quantity AS BIGINT) AS x, count(*) AS y FROM lineitem GROUP BY 1) SELECT h.x, h.y, round(sum(b.y * (4 - abs(b.x - h.x))) / 16.0, 9) AS smooth FROM h JOIN h b ON abs(b.x - h.x) <= 3 GROUP BY h.x, h.y")
def histogram_smoothing(t):
    h = t("lineitem").groupBy(F.col("l_quantity").cast("long").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return I.smooth(h, "x", "y", 3).withColumn("smooth", F.round("smooth", 9))


@query("""WITH h AS (SELECT CAST(floor(o_totalprice / 5000) AS BIGINT) AS x, count(*) AS y FROM orders GROUP BY 1), c AS (SELECT *, lag(y) OVER (ORDER BY x) AS p FROM h), d AS (SELECT x, y FROM c WHERE p IS NULL OR p <> y),
e AS (SELECT *, coalesce(lag(y) OVER (ORDER BY x), -1) AS l, coalesce(lead(y) OVER (ORDER BY x), -1) AS r FROM d) SELECT x, y FROM e WHERE y > l AND y > r AND y >= 3""")
def histogram_peaks(t):
    h = t("orders").groupBy(F.floor(F.col("o_totalprice") / 5000).alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return A.peaks(h, "x", "y", 3)


@query(f"WITH {READS} SELECT " + ", ".join(f"CAST(sum(len(bases) - len(replace(bases, '{b}', ''))) AS BIGINT) AS {b}" for b in "ACGTN") + ", count(*) AS reads, CAST(sum(len(bases)) AS BIGINT) AS bases FROM reads")
def base_composition(t):
    return A.base_composition(reads(t))


@query(f"WITH {READS} SELECT CAST(i - 1 AS INTEGER) AS pos, bases[i] AS base, count(*) AS n FROM (SELECT bases, unnest(range(1, len(bases) + 1)) AS i FROM reads) GROUP BY 1, 2")
def base_by_position(t):
    return A.by_position(reads(t))


@query(f"WITH {QUALS}, p AS (SELECT CAST(i AS INTEGER) AS pos, quals[i + 1] AS q FROM (SELECT quals, unnest(range(len(quals))) AS i FROM q)) SELECT pos, round(avg(q), 9) AS mean, min(q) AS low, max(q) AS high, quantile_cont(q, 0.5) AS median, count(*) AS n FROM p GROUP BY pos")
def quality_by_position(t):
    p = quals(t).select(F.posexplode("quals").alias("pos", "q"))
    return p.groupBy("pos").agg(F.round(F.avg("q"), 9).alias("mean"), F.min("q").alias("low"), F.max("q").alias("high"), F.percentile("q", 0.5).alias("median"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {READS} SELECT CAST(floor(len(bases) / 100) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1")
def length_histogram(t):
    return A.binned(reads(t), F.length("bases"), 100)


@query(f"WITH {READS}, h AS (SELECT CAST(floor(len(bases) / 100) AS BIGINT) AS bin, count(*) AS n FROM reads GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS share FROM h")
def cumulative_lengths(t):
    return A.cumulative(A.binned(reads(t), F.length("bases"), 100), "bin", "n").withColumn("share", F.round("share", 9))


@query("""WITH r AS (SELECT n_chars AS len, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n_chars) OVER () AS total FROM documents), p AS (SELECT unnest([50, 90]) AS percent)
SELECT CAST(percent AS INTEGER) AS percent, max(len) AS n, min(k) AS l FROM r JOIN p ON cum * 100 >= total * percent GROUP BY 1""")
def assembly_n50(t):
    return A.nx_lx(t("documents"), "n_chars")


@query("SELECT l_linenumber AS q, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS wrong, round(-10 * log10(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)), 9) AS observed_q FROM lineitem GROUP BY 1")
def quality_accuracy(t):
    return A.quality_accuracy(t("lineitem").withColumnRenamed("l_linenumber", "q"), "q", F.col("l_returnflag") == "R").withColumn("observed_q", F.round("observed_q", 9))


@query("SELECT l_partkey, count(*) AS reads, round(count(*) * 1e9 / (max(p_size) * (SELECT count(*) FROM lineitem)), 6) AS rpkm FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def rpkm(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.rpkm(j, "l_partkey", "p_size").withColumn("rpkm", F.round("rpkm", 6))


#: Line items as allele observations: the key is part and flag.
ALLELES = "SELECT l_partkey AS pos, l_returnflag AS alt, count(*) AS n, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS plus, max(l_quantity) AS top, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY 1, 2"


def alleles(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("alt")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("plus"), F.max("l_quantity").alias("top"), F.round(F.sum("l_discount"), 6).alias("total"))


@query(ALLELES)
def variant_aggregation(t):
    return alleles(t)


@query(f"WITH a AS ({ALLELES}), d AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS depth FROM a) SELECT pos, alt, n, CAST(depth AS BIGINT) AS depth, round(n / depth, 9) AS fraction FROM d WHERE n >= 8 AND n / depth >= 0.25 AND least(plus, n - plus) >= 2 AND top >= 40")
def variant_filter(t):
    """The cheap tier first; depth by a window over the same grouping."""
    d = alleles(t).withColumn("depth", F.sum("n").over(W.partitionBy("pos"))).withColumn("fraction", F.col("n") / F.col("depth"))
    kept = d.filter("n >= 8 and top >= 40 and fraction >= 0.25 and least(plus, n - plus) >= 2")
    return kept.select("pos", "alt", "n", "depth", F.round("fraction", 9).alias("fraction"))


@query("SELECT l_partkey AS pos, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS samples, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def multisample_merge(t):
    counted = t("lineitem").groupBy(F.col("l_partkey").alias("pos")).pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    samples = t("lineitem").groupBy(F.col("l_partkey").alias("pos")).agg(F.countDistinct("l_suppkey").alias("samples"))
    return counted.toDF("pos", "a", "n", "r").join(samples, "pos")


@query("WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.06) SELECT count(*) FILTER (a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS tp, count(*) FILTER (b.l_partkey IS NULL) AS fp, count(*) FILTER (a.l_partkey IS NULL) AS fn FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def concordance(t):
    li = t("lineitem")
    return A.concordance(li.filter("l_returnflag = 'R'"), li.filter("l_discount > 0.06"), ["l_partkey", "l_suppkey"])


@query("SELECT l_quantity AS score, CAST(sum(t) OVER (ORDER BY l_quantity DESC) AS BIGINT) AS tp, CAST(sum(f) OVER (ORDER BY l_quantity DESC) AS BIGINT) AS fp FROM (SELECT l_quantity, count(*) FILTER (l_returnflag = 'R') AS t, count(*) FILTER (l_returnflag <> 'R') AS f FROM lineitem GROUP BY 1)")
def score_sweep(t):
    return A.score_sweep(t("lineitem").withColumnRenamed("l_quantity", "score"), "score", F.col("l_returnflag") == "R")


def _set_sql(keep: str) -> str:
    return f"WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48), c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount = 0.1) {keep}"


def _sets(t):
    li = t("lineitem")
    return [li.filter("l_returnflag = 'R'"), li.filter("l_quantity > 48"), li.filter("l_discount = 0.1")]


@query(_set_sql("SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c"))
def set_union(t):
    return T.union(_sets(t), ["l_partkey"])


@query(_set_sql("SELECT * FROM a INTERSECT SELECT * FROM b INTERSECT SELECT * FROM c"))
def set_intersection(t):
    return T.intersect(_sets(t), ["l_partkey"])


@query(_set_sql("SELECT * FROM a EXCEPT SELECT * FROM b EXCEPT SELECT * FROM c"))
def set_difference(t):
    a, *rest = _sets(t)
    return T.subtract(a.select("l_partkey").distinct(), rest, ["l_partkey"])


@query("SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def concatenate(t):
    return t("customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind")).unionByName(t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("SELECT coalesce(a.o_custkey, b.c_custkey) AS k, a.n, b.c_acctbal AS bal FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) b ON a.o_custkey = b.c_custkey")
def full_outer_compare(t):
    a = t("orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    b = t("customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("bal"))
    return a.join(b, F.col("o_custkey") == F.col("c_custkey"), "full_outer").select(F.coalesce("o_custkey", "c_custkey").alias("k"), "n", "bal")


LINES = "lines AS (SELECT DISTINCT source, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"WITH {LINES} SELECT a.source AS a, b.source AS b, count(*) AS shared FROM lines a JOIN lines b ON a.line = b.line AND a.source < b.source GROUP BY 1, 2")
def shared_lines(t):
    return T.shared_counts(t("documents").select("source", F.explode(F.split("text", "\n")).alias("line")), "source", "line")


@query("SELECT conv_id AS name, CAST(floor(turn / 2) AS BIGINT) AS number, max(CASE WHEN turn % 2 = 0 THEN text END) AS one, max(CASE WHEN turn % 2 = 1 THEN text END) AS two, count(CASE WHEN turn % 2 = 0 THEN text END) > 0 AND count(CASE WHEN turn % 2 = 1 THEN text END) > 0 AS paired FROM conversations GROUP BY 1, 2")
def repair_pairs(t):
    """All turns, two by two."""
    rows = t("conversations").select(F.struct("conv_id", F.floor(F.col("turn") / 2).alias("number")).alias("name"), (F.col("turn") % 2).alias("pair"), "text")
    return T.repair(rows, "name", "pair", "text").select(F.col("name.conv_id").alias("name"), F.col("name.number").alias("number"), "one", "two", "paired")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 40) ")
def name_filter_exact(t):
    p = t("part")
    return R.name_filter(p, p.filter("p_size > 40").select(F.col("p_name").alias("name")), "p_name").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type FROM part WHERE EXISTS (SELECT 1 FROM (SELECT unnest(['STANDARD', 'PROMO B', 'ECONOMY POL']) AS n) WHERE starts_with(p_type, n))")
def name_filter_prefix(t):
    p = t("part")
    names = p.sparkSession.createDataFrame([("standard",), ("promo b",), ("economy pol",)], "name string")
    return R.name_filter(p.select("p_partkey", "p_type"), names, "p_type", mode="prefix", ignore_case=True)


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM (SELECT unnest(['blue', 'hot r', 'metallic']) AS n) WHERE contains(p_name, n))")
def name_filter_contains(t):
    p = t("part")
    names = p.sparkSession.createDataFrame([("blue",), ("hot r",), ("metallic",)], "name string")
    return R.name_filter(p.select("p_partkey", "p_name"), names, "p_name", mode="contains")


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT (starts_with(event_type, 'cl') OR starts_with(event_type, 'view')) GROUP BY 1")
def name_filter_prefix_exclude(t):
    """Rows of one name stay as often as they are."""
    e = t("events").select("event_type")
    names = e.sparkSession.createDataFrame([("cl",), ("view",)], "name string")
    return R.name_filter(e, names, "event_type", include=False, mode="prefix").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def name_filter_exclude(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query("SELECT e.event_id, CASE WHEN n >= 40 THEN event_type || '/' || CAST(user_id % 50 AS VARCHAR) ELSE 'unknown' END AS key FROM events e JOIN (SELECT event_type AS y, user_id % 50 AS u, count(*) AS n FROM events GROUP BY 1, 2) ON y = event_type AND u = user_id % 50")
def demultiplex(t):
    return T.demultiplex(t("events").select("event_id", "event_type", "user_id"), F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")), 40).select("event_id", "key")


@query("SELECT source, doc_id, n_chars, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def top_by_group(t):
    return T.top_by_group(t("documents").select("source", "doc_id", "n_chars"), "source", 5, F.col("n_chars").desc(), F.col("doc_id"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def sort_by_length_limit(t):
    return t("documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def limit_and_skip(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(20).limit(50)


@query("SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS part FROM orders")
def partition_ways(t):
    return T.partition(t("orders").select("o_orderkey"), 7, F.col("o_orderkey"))


@query("""WITH h AS (SELECT n_chars, sum(n_chars) AS m FROM documents GROUP BY 1), p AS (SELECT n_chars, m, least(CAST(floor((sum(m) OVER (ORDER BY n_chars) - m) * 8 / sum(m) OVER ()) AS INTEGER), 7) AS part FROM h)
SELECT part, min(n_chars) AS from_value, max(n_chars) AS to_value, CAST(sum(m) AS BIGINT) AS mass FROM p GROUP BY part""")
def equal_mass_partitions(t):
    return A.equal_mass(t("documents").withColumn("w", F.col("n_chars")), "n_chars", "w", 8)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_best(t):
    return A.best_copy(t("orders"), ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH s AS (SELECT upper(substring(md5(CAST(c_custkey % 40 AS VARCHAR)), 1, 12)) AS e, c_custkey FROM customer), b AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN e WHEN c_custkey % 3 = 1 THEN 'Z' || substring(e, 2) ELSE substring(e, 1, 5) || 'ZZZZ' || substring(e, 10) END AS barcode FROM s), x AS (SELECT DISTINCT e AS expected FROM s),
d AS (SELECT barcode, expected, len(list_filter(range(1, 13), lambda i: barcode[i] <> expected[i])) AS distance FROM b CROSS JOIN x), r AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY distance, expected) AS n, lead(distance) OVER (PARTITION BY barcode ORDER BY distance, expected) AS nxt FROM d)
SELECT barcode, expected, CAST(distance AS INTEGER) AS distance FROM r WHERE n = 1 AND distance <= 1 AND (nxt IS NULL OR nxt - distance >= 1)""")
def closest_barcode(t):
    e = F.upper(F.substring(F.md5((F.col("c_custkey") % 40).cast("string")), 1, 12))
    s = t("customer").select("c_custkey", e.alias("e"))
    seen = F.when(F.col("c_custkey") % 3 == 0, F.col("e")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Z"), F.substring("e", 2, 20))).otherwise(F.concat(F.substring("e", 1, 5), F.lit("ZZZZ"), F.substring("e", 10, 20)))
    return T.closest_barcode(s.select(seen.alias("barcode")), s.select(F.col("e").alias("barcode")), 1, 1)


#: Regions, nations and customers as a tree: nodes r*, n*, c* under "root".
TREE = "tree AS (SELECT 'root' AS node, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
CLOSED = f"WITH RECURSIVE {TREE}, up(node, ancestor, steps) AS (SELECT node, node, 0 FROM tree UNION ALL SELECT up.node, tree.parent, steps + 1 FROM up JOIN tree ON tree.node = up.ancestor WHERE tree.parent IS NOT NULL)"


def tree(t):
    def part(df, prefix, key, up, parent):
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"), (F.lit(up) if parent is None else F.concat(F.lit(up), F.col(parent).cast("string"))).alias("parent"))

    root = t("region").limit(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    return root.union(part(t("region"), "r", "r_regionkey", "root", None)).union(part(t("nation"), "n", "n_nationkey", "r", "n_regionkey")).union(part(t("customer"), "c", "c_custkey", "n", "c_nationkey"))


@query(CLOSED + " SELECT node, ancestor, steps FROM up")
def tree_closure(t):
    return G.closure(tree(t), "node", "parent")


@query(CLOSED + ", f AS (SELECT 'c' || o_custkey AS node, count(*) AS v FROM orders GROUP BY 1) SELECT ancestor, CAST(sum(v) AS BIGINT) AS total FROM f JOIN up USING (node) GROUP BY 1")
def tree_rollup(t):
    facts = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.lit(1).alias("v"))
    return A.rollup_tree(facts, "node", "v", G.closure(tree(t), "node", "parent"))


@query(CLOSED + ", p AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)) SELECT a, b, min_by(x.ancestor, x.steps) AS lca FROM p JOIN up x ON x.node = a JOIN up y ON y.node = b AND y.ancestor = x.ancestor GROUP BY a, b")
def common_ancestor(t):
    c = t("customer").select("c_custkey")
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"))
    pairs = c.join(nxt, "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("c"), (F.col("c_custkey") + 1).cast("string")).alias("b"))
    return G.common_ancestor(G.closure(tree(t), "node", "parent"), pairs, "a", "b")


@query("SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def grouping_sets(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1, 2")
def percentile_stats(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.percentile("l_quantity", 0.5).alias("median"), F.percentile("l_quantity", 0.9).alias("p90"))


@query("SELECT a.l_partkey AS k, round(corr(a.l_quantity, a.l_extendedprice), 5) AS r, count(*) AS n FROM lineitem a GROUP BY 1 HAVING count(*) >= 20")
def matrix_correlation(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.corr("l_quantity", "l_extendedprice"), 5).alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query("WITH s AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1), z AS (SELECT avg(m) AS mm, stddev_pop(m) AS sd FROM s) SELECT l_suppkey, round((m - mm) / sd, 6) AS z FROM s, z WHERE (m - mm) / sd > 1")
def tile_zscore(t):
    s = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    z = s.agg(F.avg("m").alias("mm"), F.stddev_pop("m").alias("sd"))
    return s.crossJoin(z).select("l_suppkey", F.round((F.col("m") - F.col("mm")) / F.col("sd"), 6).alias("z")).filter("z > 1")  # one row beside each


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(f"WITH {WORDS} SELECT source, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM words GROUP BY 1")
def scan_report(t):
    return words(t).groupBy("source").agg(F.sum(F.size("w")).alias("words"), F.sum((F.size("w") == 0).cast("int")).alias("empty"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distance(t):
    v = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    dot = F.aggregate(F.zip_with("v", "u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return v.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(dot, 6).alias("dot"))
