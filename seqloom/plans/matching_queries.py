"""Trims, masks and splits by k-mers of benchmark, tips, neighbourhoods, thresholds, entropy in windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import complexity as C
from seqloom.operators import kmers as K
from seqloom.operators import matching as M
from seqloom.plans.kmer_queries import BENCH_READS, bench_reads
from seqloom.plans.registry import READS, kmer_sql, query, reads

HITS = f"{READS}, {BENCH_READS}, ref AS (SELECT kmer, min(id) AS ref_id FROM {kmer_sql(11, 'br')} GROUP BY kmer), hit AS (SELECT k.id, k.pos, ref_id FROM {kmer_sql(11)} k JOIN ref USING (kmer))"


def _found(t):
    r = reads(t).select("id", "bases")
    return r, M.found(r, "id", "bases", 11, M.index(bench_reads(t), "id", "bases", 11))


@query(f"WITH {HITS}, e AS (SELECT id, min(pos) AS p FROM hit GROUP BY id) SELECT id, substring(bases, 1, coalesce(p, len(bases))) AS bases FROM reads LEFT JOIN e USING (id)")
def kmer_trim_right(t):
    r, hits = _found(t)
    return M.trim(r, hits, "id", "bases", 11)


@query(f"WITH {HITS}, e AS (SELECT id, max(pos) + 11 AS p FROM hit GROUP BY id) SELECT id, substring(bases, coalesce(p, 0) + 1) AS bases FROM reads LEFT JOIN e USING (id)")
def kmer_trim_left(t):
    r, hits = _found(t)
    return M.trim(r, hits, "id", "bases", 11, "left")


MASKED = f"""WITH {HITS}, c AS (SELECT DISTINCT id, unnest(range(pos, pos + 11)) AS p FROM hit), b AS (SELECT id, unnest(range(len(bases))) AS p, bases FROM reads WHERE id IN (SELECT id FROM c)),
m AS (SELECT b.id, string_agg(CASE WHEN c.p IS NULL THEN bases[b.p + 1] ELSE '#' END, '' ORDER BY b.p) AS bases FROM b LEFT JOIN c ON c.id = b.id AND c.p = b.p GROUP BY b.id), x AS (SELECT id, coalesce(m.bases, r.bases) AS bases FROM reads r LEFT JOIN m USING (id))"""


@query(MASKED + " SELECT id, replace(bases, '#', 'N') AS bases FROM x")
def kmer_mask(t):
    r, hits = _found(t)
    return M.mask(r, hits, "id", "bases", 11)


@query(MASKED + ", s AS (SELECT id, list_filter(string_split_regex(bases, '#+'), lambda y: len(y) >= 20) AS l FROM x) SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS piece, unnest(l) AS bases FROM s")
def kmer_split(t):
    r, hits = _found(t)
    return M.split(r, hits, "id", "bases", 11, 20)


@query(f"WITH {READS}, {BENCH_READS}, p AS (SELECT DISTINCT substring(bases, 1, n) AS part FROM br, (SELECT unnest(range(4, 11)) AS n) WHERE len(bases) >= 4), e AS (SELECT id, max(n) AS tip FROM reads, (SELECT unnest(range(4, 11)) AS n) WHERE len(bases) >= n AND right(bases, n) IN (SELECT part FROM p WHERE len(part) = n) GROUP BY id) SELECT id, substring(bases, 1, len(bases) - coalesce(tip, 0)) AS bases FROM reads LEFT JOIN e USING (id)")
def short_kmer_tips(t):
    r = reads(t).select("id", "bases")
    return M.trim_tips(r, M.tip_matches(r, bench_reads(t), "id", "bases", 11, 4), "id", "bases")


@query(f"""WITH {READS}, {BENCH_READS}, ref AS (SELECT kmer, min(id) AS ref_id FROM {kmer_sql(9, 'br')} GROUP BY kmer), own AS (SELECT DISTINCT kmer FROM {kmer_sql(9)}),
near AS (SELECT o.kmer, min(ref_id) AS ref_id FROM (SELECT kmer, substring(kmer, 1, i - 1) || a || substring(kmer, i + 1) AS m FROM (SELECT kmer, unnest(range(1, 10)) AS i FROM own) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS a)) o JOIN ref r ON r.kmer = o.m GROUP BY o.kmer)
SELECT id, min(ref_id) AS ref_id, count(*) AS hits FROM {kmer_sql(9)} k JOIN near USING (kmer) GROUP BY id""")
def kmer_query_neighbours(t):
    """Substitutions on the side of the reads."""
    hits = M.found_near(reads(t), "id", "bases", 9, M.index(bench_reads(t), "id", "bases", 9))
    return hits.groupBy("id").agg(F.min("ref_id").alias("ref_id"), F.count(F.lit(1)).alias("hits"))


@query(f"""WITH {READS}, {BENCH_READS}, own AS (SELECT DISTINCT substring(bases, i, 9) AS kmer, substring(bases, i + 9, 1) AS c FROM (SELECT unnest(string_split_regex(bases, '[^ACGT]+')) AS bases FROM br) x, (SELECT unnest(range(1, 100000)) AS i) WHERE i + 8 <= len(bases)),
n AS (SELECT substring(kmer, 1, i - 1) || a || substring(kmer, i + 1) AS kmer FROM own, (SELECT unnest(range(1, 10)) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS a)
  UNION SELECT substring(kmer, 1, i - 1) || substring(kmer, i + 1) || c FROM own, (SELECT unnest(range(1, 10)) AS i) WHERE len(c) = 1
  UNION SELECT substring(kmer, 1, i - 1) || a || substring(kmer, i, 9 - i) FROM own, (SELECT unnest(range(1, 10)) AS i), (SELECT unnest(['A', 'C', 'G', 'T']) AS a))
SELECT id, count(*) AS hits FROM {kmer_sql(9)} k WHERE kmer IN (SELECT kmer FROM n) GROUP BY id HAVING count(*) >= 2""")
def kmer_edit_neighbours(t):
    """Substitutions, deletions and insertions on the side of the references."""
    hits = M.found(reads(t), "id", "bases", 9, M.index(bench_reads(t), "id", "bases", 9, 1, edits=True))
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 2")


@query(f"WITH {HITS}, s AS (SELECT id, count(*) AS hits FROM hit GROUP BY id), c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(pos, pos + 11)) AS p FROM hit) GROUP BY id) SELECT id, hits, round(hits / (len(bases) - 10), 9) AS fraction, round(n / len(bases), 9) AS covered FROM reads JOIN s USING (id) JOIN c USING (id) WHERE hits >= 1 AND hits / (len(bases) - 10) >= 0.0001 AND n / len(bases) >= 0.001")
def kmer_thresholds(t):
    r, hits = _found(t)
    return M.thresholds(r, hits, "id", "bases", 11, 1, 0.0001, 0.001).withColumns({c: F.round(c, 9) for c in ("fraction", "covered")})


@query(f"WITH {HITS}, s AS (SELECT id, ref_id, count(*) AS hits FROM hit GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY hits DESC) AS k FROM s) SELECT id, min_by(ref_id, md5(id || '-' || ref_id)) AS ref_id, max(hits) AS hits FROM r WHERE k = 1 GROUP BY id")
def kmer_best_reference_random(t):
    """Of references with equally many hits one by a hash of both names."""
    _, hits = _found(t)
    best = K.best_reference(hits, "id", "all")
    drawn = F.md5(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("ref_id").cast("string")))
    return best.groupBy("id").agg(F.min_by("ref_id", drawn).alias("ref_id"), F.max("hits").alias("hits"))


SIDES = "x AS (SELECT id, source, bases, greatest(bases, reverse(translate(bases, 'ACGT', 'TGCA'))) AS c FROM reads)"


@query(f"WITH {READS}, {SIDES} SELECT id FROM x WHERE c IN (SELECT c FROM x GROUP BY c HAVING count(*) > 1)")
def sequence_semi_join(t):
    """Reads whose sequence, on either strand, more than one read has."""
    r = reads(t).select("id", "bases")
    twice = r.groupBy(S.canonical(F.col("bases")).alias("bases")).count().filter("count > 1")
    return M.by_sequence(r, twice, "bases").select("id")


@query(f"WITH {READS}, {SIDES} SELECT id FROM x WHERE c NOT IN (SELECT c FROM x GROUP BY c HAVING count(*) > 1)")
def sequence_anti_join(t):
    r = reads(t).select("id", "bases")
    twice = r.groupBy(S.canonical(F.col("bases")).alias("bases")).count().filter("count > 1")
    return M.by_sequence(r, twice, "bases", include=False).select("id")


ENTROPY = f"""WITH {READS}, r AS (SELECT id, bases, least(48, len(bases) - 2) AS size FROM reads WHERE len(bases) >= 3), k AS (SELECT id, size, i, substring(bases, i, 3) AS kmer FROM (SELECT id, bases, size, unnest(range(1, len(bases) - 1)) AS i FROM r)),
w AS (SELECT k.id, s.s, k.size, kmer, count(*) AS n FROM k JOIN (SELECT id, unnest(range(1, len(bases) - 2 - size + 2)) AS s FROM r) s ON s.id = k.id AND k.i >= s.s AND k.i < s.s + k.size GROUP BY ALL),
v AS (SELECT id, s, max(size) AS size, CASE WHEN max(size) > 1 THEN sum(-(n / size) * ln(n / size)) / ln(max(size)) ELSE 0 END AS h FROM w GROUP BY id, s)"""


@query(ENTROPY + ", f AS (SELECT id, min(h) AS lo, avg(h) AS mean FROM v GROUP BY id) SELECT r.id, round(lo, 6) AS low_entropy, round(mean, 6) AS mean_entropy FROM reads r JOIN f USING (id)")
def window_entropy(t):
    r = reads(t).select("id", "bases").filter(F.length("bases") >= 3)
    return C.windowed(r, window=50, k=3).select("id", F.round("low_entropy", 6).alias("low_entropy"), F.round("mean_entropy", 6).alias("mean_entropy"))


LOW = ENTROPY + """, lo AS (SELECT DISTINCT v.id, unnest(range(s, least(s + 50, len(bases) + 1))) AS p FROM v JOIN r USING (id) WHERE h < 0.8), b AS (SELECT id, bases, unnest(range(1, len(bases) + 1)) AS p FROM r),
m AS (SELECT b.id, string_agg(CASE WHEN lo.p IS NULL THEN bases[b.p] ELSE '#' END, '' ORDER BY b.p) AS masked, any_value(bases) AS bases FROM b LEFT JOIN lo ON lo.id = b.id AND lo.p = b.p GROUP BY b.id)"""


@query(LOW + " SELECT id, replace(masked, '#', 'N') AS bases, CAST(len(masked) - len(replace(masked, '#', '')) AS INTEGER) AS low_bases FROM m")
def entropy_mask(t):
    r = reads(t).select("id", "bases").filter(F.length("bases") >= 3)
    return C.windowed(r, window=50, k=3, least=0.8, mode="mask").select("id", "bases", "low_bases")


@query(LOW + " SELECT id, substring(bases, len(regexp_extract(masked, '^#*')) + 1, len(bases) - len(regexp_extract(masked, '^#*')) - CASE WHEN replace(masked, '#', '') = '' THEN 0 ELSE len(regexp_extract(masked, '#*$')) END) AS bases FROM m")
def entropy_trim(t):
    r = reads(t).select("id", "bases").filter(F.length("bases") >= 3)
    return C.windowed(r, window=50, k=3, least=0.8, mode="trim").select("id", "bases")
