"""Filters, trims, edits and scalar functions over reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import rows as R
from seqloom.operators import sets as T
from seqloom.plans.registry import QUALS, READS, quals, query, reads


@query(f"WITH {READS} SELECT id, CAST(len(bases) AS INTEGER) AS n FROM reads WHERE len(bases) BETWEEN 200 AND 1000")
def length_filter(t):
    return R.filter_chain(reads(t), min_length=200, max_length=1000).select("id", F.length("bases").alias("n"))


GC = "len(regexp_replace(bases, '[^GC]', '', 'g'))"
ACGT = "len(regexp_replace(bases, '[^ACGT]', '', 'g'))"


@query(f"WITH {READS} SELECT id, round(CASE WHEN {ACGT} > 0 THEN {GC} / {ACGT} ELSE 0 END, 9) AS gc FROM reads WHERE CASE WHEN {ACGT} > 0 THEN {GC} / {ACGT} ELSE 0 END BETWEEN 0.2 AND 0.35")
def gc_filter(t):
    return R.filter_chain(reads(t), min_gc=0.2, max_gc=0.35).select("id", F.round(S.gc(F.col("bases")), 9).alias("gc"))


@query(f"WITH {READS} SELECT id FROM reads WHERE len(regexp_replace(bases, '[^N]', '', 'g')) <= 60 AND list_max(list_transform(string_split_regex(bases, '[^ACGT]+'), lambda x: len(x))) >= 12")
def ambiguous_and_run_filter(t):
    return R.filter_chain(reads(t), max_ns=60, min_run=12).select("id")


@query(f"WITH {READS} SELECT id FROM reads WHERE least(len(bases) - len(replace(bases, 'A', '')), len(bases) - len(replace(bases, 'C', '')), len(bases) - len(replace(bases, 'G', '')), len(bases) - len(replace(bases, 'T', ''))) >= 0.02 * len(bases)")
def base_frequency_filter(t):
    return R.filter_chain(reads(t), min_base_frequency=0.02).select("id")


@query(f"WITH {QUALS} SELECT id, round(-10 * log10(list_sum(list_transform(quals, lambda x: pow(10, -x / 10.0))) / len(quals)), 6) AS mean_q, round(list_sum(list_transform(quals, lambda x: pow(10, -x / 10.0))), 6) AS errors FROM q")
def average_quality(t):
    return quals(t).select("id", F.round(S.average_quality(F.col("quals")), 6).alias("mean_q"), F.round(S.expected_errors(F.col("quals")), 6).alias("errors"))


@query(f"WITH {QUALS} SELECT id, list_min(quals) AS least FROM q WHERE list_min(quals) >= 1")
def base_quality_minimum(t):
    return quals(t).select("id", F.array_min("quals").alias("least")).filter("least >= 1")


@query(f"WITH {QUALS} SELECT id, coalesce(list_min(list_filter(range(len(quals) - 1), lambda i: quals[i + 1] > 10 AND quals[i + 2] > 10)), len(quals)) AS cut FROM q")
def quality_trim_left(t):
    return quals(t).select("id", S.left_trim_run(F.col("quals"), 10).cast("long").alias("cut"))


@query(f"WITH {QUALS}, r AS (SELECT id, list_reverse(quals) AS quals FROM q) SELECT id, coalesce(list_min(list_filter(range(len(quals) - 1), lambda i: quals[i + 1] > 15 AND quals[i + 2] > 15)), len(quals)) AS cut FROM r")
def quality_trim_right(t):
    return quals(t).select("id", S.right_trim_run(F.col("quals"), 15).cast("long").alias("cut"))


@query(f"""WITH {QUALS}, w AS (SELECT id, len(quals) AS n, list_min(list_filter(range(greatest(len(quals) - 3, 0)), lambda i: quals[i + 1] + quals[i + 2] + quals[i + 3] + quals[i + 4] < 40)) AS cut FROM q)
SELECT id, coalesce(cut, n) AS kept FROM w""")
def quality_trim_window(t):
    return quals(t).select("id", S.window_trim_right(F.col("quals"), 4, 10).cast("long").alias("kept"))


@query()
def quality_trim_optimal(t):
    """Bases left by the optimal trim; tested against brute force."""
    out = R.quality_trim(quals(t), "optimal", 10.0)
    return out.select("id", F.length("bases").alias("kept"), F.round(S.expected_errors(F.col("quals")), 6).alias("errors"))


@query(f"WITH {READS} SELECT id, regexp_replace(bases, '^N+|N+$', '', 'g') AS bases FROM reads")
def n_end_trim(t):
    return reads(t).select("id", R.n_trim(F.col("bases")).alias("bases"))


@query(f"WITH {READS} SELECT id, substring(bases, 6, greatest(least(len(bases) - 3, len(bases) - len(bases) % 5, 501) - 5, 0)) AS bases FROM reads")
def forced_trim(t):
    right = S.forced_right(F.col("bases"), to=500, off=3, modulo=5)
    return reads(t).select("id", F.substring("bases", F.lit(6), F.greatest(right - 5, F.lit(0))).alias("bases"))


@query(f"WITH {READS} SELECT id, reverse(translate(bases, 'ACGT', 'TGCA')) AS rc FROM reads")
def reverse_complement(t):
    return reads(t).select("id", S.reverse_complement(F.col("bases")).alias("rc"))


@query(f"WITH {READS} SELECT id, CAST(j AS INTEGER) AS piece, substring(bases, j * 100 + 1, 100) AS bases FROM (SELECT id, bases, unnest(range(greatest(CAST(ceil(len(bases) / 100.0) AS BIGINT), 1))) AS j FROM reads)")
def break_long(t):
    return R.break_long(reads(t).select("id", "bases"), 100)


@query(f"WITH {READS} SELECT id, CAST(s AS INTEGER) AS start, substring(bases, s + 1, 200) AS bases FROM (SELECT id, bases, unnest(range(0, greatest(len(bases) - 200 + 50 - 1, 0) + 1, 50)) AS s FROM reads) WHERE s = 0 OR s < len(bases)")
def shred(t):
    return R.shred(reads(t).select("id", "bases"), 200, 50)


@query(f"WITH {QUALS} SELECT id, list_sum(list_transform(quals, lambda x: CASE WHEN x <= 7 THEN 2 WHEN x <= 19 THEN 12 WHEN x <= 31 THEN 26 ELSE 37 END))::BIGINT AS total FROM q")
def quantise_quality(t):
    return quals(t).select("id", F.aggregate(R.quantise(F.col("quals"), (2, 12, 26, 37)), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {READS} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bases, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g'), 'N+', 'N', 'g') AS bases FROM reads")
def shrink_homopolymers(t):
    return reads(t).select("id", R.shrink_homopolymers(F.col("bases")).alias("bases"))


@query(f"WITH {READS} SELECT id, len(regexp_extract(bases, '[TN]{{2,}}$')) AS tail, len(regexp_extract(bases, '^[TN]{{2,}}')) AS head FROM reads")
def polymer_ends(t):
    return reads(t).select("id", F.length(F.regexp_extract("bases", "[TN]{2,}$", 0)).cast("long").alias("tail"), F.length(F.regexp_extract("bases", "^[TN]{2,}", 0)).cast("long").alias("head"))


@query(f"WITH {READS} SELECT id, substring(bases, 1, 10) || repeat('N', greatest(20 - 10, 0)) || substring(bases, 21) AS masked FROM reads WHERE len(bases) >= 30")
def mask_span(t):
    return reads(t).filter(F.length("bases") >= 30).select("id", R.mask(F.col("bases"), F.lit(10), F.lit(20)).alias("masked"))


@query(
    """SELECT p_partkey, p_name, route FROM (SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'dear' ELSE 'other' END AS route FROM part)"""
)
def route_rows(t):
    return R.route(t("part"), {"small": F.col("p_size") < 10, "dear": F.col("p_retailprice") > 1500}).select("p_partkey", "p_name", "route")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey & 5) = 5 AND (l_partkey & 8) = 0")
def flag_bits_filter(t):
    return R.flags_filter(t("lineitem"), "l_partkey", 5, 8).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'R' AND l_discount >= 0.05 AND NOT (l_linestatus = 'O' AND l_tax > 0.06)")
def record_filter(t):
    return t("lineitem").filter("l_quantity between 10 and 20 and l_returnflag <> 'R' and l_discount >= 0.05 and not (l_linestatus = 'O' and l_tax > 0.06)").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS pair, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) = 1) GROUP BY 1")
def pair_filter(t):
    return R.keep_pairs(t("lineitem"), "l_orderkey", F.col("l_quantity") >= 45).groupBy(F.col("l_orderkey").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text FROM (SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g') AS text FROM documents WHERE text IS NOT NULL) WHERE text LIKE '%?%'")
def unicode_to_ascii(t):
    return t("documents").filter("text is not null").select("doc_id", F.regexp_replace("text", r"[^\x20-\x7E]", "?").alias("text")).filter(F.col("text").contains("?"))


@query("SELECT c_custkey, 'cust_' || CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS VARCHAR) AS id FROM customer")
def rename_rows(t):
    return R.rename(t("customer"), "cust", [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_custkey", "id")


@query("SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '_' || CAST(n AS VARCHAR) ELSE p_brand END AS p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unique_names(t):
    return R.unique_names(t("part"), "p_brand", F.col("p_partkey")).select("p_partkey", "p_brand")


@query("SELECT event_id, regexp_extract(props, '\"([a-z_]+)\":', 1) AS term, try_cast(regexp_extract(props, ':\\s*\"?([-0-9.]+)', 1) AS DOUBLE) AS number FROM events")
def tag_values(t):
    return t("events").select("event_id", F.regexp_extract("props", '"([a-z_]+)":', 1).alias("term"), F.regexp_extract("props", r':\s*"?([-0-9.]+)', 1).try_cast("double").alias("number"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(url, ':', 1) AS scheme, len(string_split(url, '/')) AS parts FROM pages")
def header_fields(t):
    url = F.col("url")
    return t("pages").select("page_id", F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.split_part(url, F.lit(":"), F.lit(1)).alias("scheme"), F.size(F.split(url, "/")).cast("long").alias("parts"))


ENTROPY = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / n) * ln({c} / n) ELSE 0 END" for c in "acgt")


COUNTS = ", ".join(f"len(bases) - len(replace(bases, '{x.upper()}', '')) AS {x}" for x in "acgt")


@query(f"WITH {READS}, c AS (SELECT id, {COUNTS} FROM reads), d AS (SELECT *, a + c + g + t AS n FROM c) SELECT id, round(CASE WHEN n > 1 THEN ({ENTROPY}) / ln(n) ELSE 0 END, 6) AS entropy FROM d")
def entropy(t):
    return reads(t).select("id", F.round(S.mean_kmer_entropy(F.col("bases")), 6).alias("entropy"))


@query(f"WITH {READS} SELECT id, len(bases) - len(regexp_replace(bases, 'TGA|TAA|TAG', '', 'g')) AS stops FROM reads")
def motif_count(t):
    return reads(t).select("id", (F.length("bases") - F.length(F.regexp_replace("bases", "TGA|TAA|TAG", ""))).cast("long").alias("stops"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_filter(range(1, len(a.p_brand) + 1), lambda i: a.p_brand[i] <> b.p_brand[i])) AS d, levenshtein(a.p_type, b.p_type) AS e FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND len(a.p_brand) = len(b.p_brand)")
def hamming_and_edit(t):
    part = t("part").select("p_partkey", "p_size", "p_brand", "p_type")
    classes = T.class_pairs(part, "p_partkey", ["p_size"], {"p_brand": ("ab", "bb"), "p_type": ("at", "bt")}).filter("length(ab) = length(bb)")
    scored = classes.select("_a", "_b", S.hamming(F.col("ab"), F.col("bb")).cast("long").alias("d"), F.levenshtein("at", "bt").cast("long").alias("e"))
    return T.paired(scored, "d", "e")
