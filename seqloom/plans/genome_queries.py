"""Alignment, correction, consensus, genes, variants and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import alignment as L
from seqloom.operators import genomes as G
from seqloom.operators import sets as T
from seqloom.plans.registry import query, reads


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(-levenshtein(a.p_name, b.p_name) AS INTEGER) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def align_pairs(t):
    part = t("part").select("p_partkey", "p_brand", "p_size", "p_name")
    classes = T.class_pairs(part, "p_partkey", ["p_brand", "p_size"], {"p_name": ("x", "y")})
    texts = L.aligned(classes.select("x", "y").distinct(), "x", "y", match=0).select(F.col("x").alias("x2"), F.col("y").alias("y2"), "score")
    return T.paired(classes.join(texts, F.col("x").eqNullSafe(F.col("x2")) & F.col("y").eqNullSafe(F.col("y2"))), "score")


@query("""WITH w AS (SELECT l_suppkey AS k, l_partkey % 50 AS p, l_returnflag AS b, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY w DESC, b) AS n FROM w)
SELECT k, string_agg(b, '' ORDER BY p) AS consensus, CAST(count(*) AS INTEGER) AS positions FROM r WHERE n = 1 GROUP BY k""")
def consensus_vote(t):
    votes = t("lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("p"), F.col("l_returnflag").alias("b"), F.col("l_linenumber").alias("w"))
    return G.consensus(votes, "k", "p", "b", "w")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, tanh(0.5 * l_discount * 10 - 0.25 * l_tax * 10 + 0.1) AS a, tanh(l_discount * 10 + l_tax * 10) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(2 * a - b + 0.5))), 6) AS score FROM f""")
def network_score(t):
    x = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10)
    out = G.network(x, [([[0.5, -0.25], [1.0, 1.0]], [0.1, 0.0]), ([[2.0, -1.0]], [0.5])])
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.get(out, F.lit(0)), 6).alias("score"))


@query("""SELECT p_partkey, CAST(len(p_brand) AS INTEGER) AS pos, right(p_brand, 1) AS ref, right(p_brand, 1) || right(p_type, 2) AS alt FROM part WHERE right(p_brand, 1) <> right(p_type, 1)""")
def normalise_variants(t):
    p = t("part").filter(F.right("p_brand", F.lit(1)) != F.right("p_type", F.lit(1)))
    v = G.normalise_variant(F.lit(1), F.col("p_brand"), F.concat("p_brand", F.right("p_type", F.lit(2))))
    return p.select("p_partkey", v.alias("v")).select("p_partkey", "v.pos", "v.ref", "v.alt")


@query("SELECT doc_id, CAST(i AS INTEGER) AS allele, alt FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS alt FROM (SELECT doc_id, string_split(text, ',') AS l FROM documents))")
def split_alleles(t):
    """Every piece between commas of the whole text."""
    return G.split_alleles(t("documents").select("doc_id", F.col("text").alias("alt"))).select("doc_id", "allele", "alt")


@query()
def tandem_repeats(t):
    """Pairs of symbols that stand three times or more in a row; SQL here has no back references."""
    return G.tandem_repeats(reads(t), "id", "bases", 2, 3)


@query()
def open_reading_frames(t):
    """Tested against a small hand-made contig."""
    return G.open_frames(reads(t), "id", "bases", 60)


@query()
def correct_errors(t):
    """Tested on made-up reads with planted errors."""
    return G.correct_errors(reads(t).select("id", "bases"), "id", "bases", 21, 3).filter("fixed > 0")


@query()
def merge_mates(t):
    """Each read's first half and the reverse complement of its last two thirds, merged again."""
    n = F.length("bases")
    one, two = F.substring("bases", F.lit(1), F.floor(n / 2).cast("int")), F.substring("bases", F.floor(n / 3).cast("int") + 1, n)
    return L.merged_mates(reads(t).select("id", one.alias("one"), S.reverse_complement(two).alias("two"))).select("id", "overlap", F.length("merged").alias("length"))
