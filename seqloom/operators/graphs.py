"""Components, trees, assembly and covers: joins repeated until they come to rest, cut by checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; where none is set, in a temporary one on a local master, and an error on a cluster."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    done = df.checkpoint(eager=True)
    return done.select(*[F.col(c).alias(c) for c in done.columns])  # fresh columns: a union of a frame with its own self-join needs them


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, component)``: the least node that a chain of edges reaches."""
    both = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("m"))
        moved = labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("to"))
        jump = labels.select(F.col("node").alias("k"), F.col("component").alias("far"))
        moved = cut(moved.join(jump, F.col("to") == F.col("k"), "left").select("node", "old", F.least("to", "far").alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def closure(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, ancestor, steps)``, the node itself at 0: paths double each round, so rounds grow with the logarithm of the depth."""
    edges = parents.filter(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"))
    paths = cut(edges)
    while True:
        far = paths.select(F.col("node").alias("n2"), F.col("ancestor").alias("a2"), F.col("steps").alias("s2"))
        longer = paths.join(far, F.col("ancestor") == F.col("n2")).select("node", F.col("a2").alias("ancestor"), (F.col("steps") + F.col("s2")).alias("steps"))
        grown = cut(paths.union(longer).distinct())
        if grown.count() == paths.count():
            own = parents.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("steps"))
            return grown.union(own)
        paths = grown


def common_ancestor(closed: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, lca)``: the nearest node above both."""
    left = closed.select(F.col("node").alias(a), F.col("ancestor").alias("lca"), F.col("steps").alias("sa"))
    right = closed.select(F.col("node").alias(b), F.col("ancestor").alias("lca"), F.col("steps").alias("sb"))
    met = pairs.select(a, b).join(left, a).join(right, [b, "lca"])
    return met.groupBy(a, b).agg(F.min(F.struct("sa", "lca")).alias("m")).select(a, b, F.col("m.lca").alias("lca"))


def unitigs(counted: DataFrame, k: int, least: int = 1) -> DataFrame:
    """``(seq, kmers, depth)`` of the forward-strand de Bruijn graph: maximal paths without branches.

    A k-mer is followed by the one that shares its last k - 1 symbols if that is its only follower and
    it is that one's only forerunner. Chains are contracted by pointer jumping, so rounds grow with the
    logarithm of their length. A cycle without a branch is cut before its least k-mer.
    """
    nodes = cut(counted.filter(F.col("n") >= least).select("kmer", "n"))
    ends = nodes.select("kmer", F.substring("kmer", 2, k - 1).alias("key"))
    starts = nodes.select(F.col("kmer").alias("next"), F.substring("kmer", 1, k - 1).alias("key"))
    links = ends.join(starts, "key").filter("kmer <> next")
    single_out = links.groupBy("kmer").agg(F.count(F.lit(1)).alias("o"), F.min("next").alias("next")).filter("o = 1")
    single_in = links.groupBy("next").agg(F.count(F.lit(1)).alias("i")).filter("i = 1").select("next")
    loops = ends.join(starts, "key").filter("kmer = next").select(F.col("kmer").alias("x"))
    step = single_out.join(single_in, "next").select("kmer", "next").join(loops, F.col("kmer") == F.col("x"), "left_anti").join(loops, F.col("next") == F.col("x"), "left_anti")
    back = cut(step.select(F.col("next").alias("kmer"), F.col("kmer").alias("before")))
    state = cut(nodes.join(back, "kmer", "left").select("kmer", F.col("before").alias("to"), F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("steps"), F.least("kmer", F.coalesce("before", "kmer")).alias("low")))
    size, jumped = state.count(), 1
    while jumped <= 2 * size and not state.filter("to is not null").isEmpty():
        far = state.select(F.col("kmer").alias("k"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        state = cut(state.join(far, F.col("to") == F.col("k"), "left").select("kmer", F.col("to2").alias("to"), F.when(F.col("k").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.when(F.col("k").isNull(), F.lit(True)).otherwise(F.col("to2").isNull()).alias("ended")).drop("ended"))
        jumped *= 2
    cycles = state.filter("to is not null").select("kmer", "low")
    if cycles.isEmpty():
        placed = chain_heads(nodes, back)
    else:
        opened = back.join(cycles.filter("kmer = low").select(F.col("kmer").alias("c")), F.col("kmer") == F.col("c"), "left_anti")
        placed = chain_heads(nodes, cut(opened))
    last = F.substring("kmer", -1, 1)
    rows = placed.join(nodes, "kmer").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", last.alias("c")))).alias("tail"), F.count(F.lit(1)).alias("kmers"), F.avg("n").alias("depth"))
    tail = F.array_join(F.transform(F.slice("tail", 2, F.greatest(F.size("tail") - 1, F.lit(0))), lambda x: x["c"]), "")
    return rows.select(F.concat("head", tail).alias("seq"), "kmers", "depth")


def chain_heads(nodes: DataFrame, back: DataFrame) -> DataFrame:
    """``(kmer, head, place)`` by pointer jumping over ``back(kmer, before)`` without cycles."""
    state = cut(nodes.select("kmer").join(back, "kmer", "left").select("kmer", F.coalesce("before", "kmer").alias("head"), F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("place")))
    while True:
        far = state.select(F.col("kmer").alias("k"), F.col("head").alias("h2"), F.col("place").alias("p2"))
        grown = cut(state.join(far, F.col("head") == F.col("k")).select("kmer", F.col("h2").alias("head"), (F.col("place") + F.col("p2")).alias("place"), (F.col("p2") > 0).alias("moved")))
        state = grown.select("kmer", "head", "place")
        if grown.filter("moved").isEmpty():
            return state


def greedy_cover(members: DataFrame, group: str, item: str, most: int | None = None) -> list:
    """Groups that cover all items: the one with most uncovered items, again and again; ties by least id. All items are covered unless ``most`` groups are to do. One small row a round comes back."""
    left, chosen = cut(members.select(group, item).distinct()), []
    while most is None or len(chosen) < most:
        best = left.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), group).first()
        if best is None:
            break
        chosen.append(best[0])
        gone = left.filter(F.col(group) == best[0]).select(F.col(item).alias("_i"))
        left = cut(left.join(gone, F.col(item) == F.col("_i"), "left_anti"))
    return chosen
