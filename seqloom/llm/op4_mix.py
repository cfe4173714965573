"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source's documents share one expected number of copies, its target over its
size; the whole part is taken, the fraction is rounded by a dependent scheme.
Two documents with fractional copy probabilities exchange words: one gives as many
expected words as the other gains, until one probability is 0 or 1; which way is
drawn so that every probability stays right on average. The words a source is
expected to give so never change, and the rounded sum misses its target by less
than one document. Blocks of about ``BLOCK`` documents are folded first; each leaves
one undecided document, and these are folded in blocks again up a reduction tree.

Rows with the same id, source and size can't be told apart. They are rounded as one
unit with the sum of their expected copies, which is then dealt out to them as evenly
as it goes, so a table of repeated rows never meets in one block.

Defined results: a null text has size 0; a source without words has target 0; null
is a source of its own, last in order; documents of size 0 take 0 words. A unit is
decided by a hash of its ``doc_id`` and size, so reruns agree; repeated rows are
documents of their own. An empty table gives an empty result; further columns are
ignored. Sources may be as many as rows: they are numbered and summed over range
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import NULL_ID, checkpoint, fresh, row_id, running, spread_join, table

BLOCK = 64
#: Equal rows written out at once.
CHUNK = 4096
SEED = 20240501


def words(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, documents, target)``.

    Targets are ``least(most * size, level * weight)`` for the level at which they sum to the share of
    all sizes, which is where resharing the excess by weight comes to rest.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    ranked = running(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    ranked = ranked.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("w"), (most * F.col("source_size")).alias("cap"))
    filled = checkpoint(running(ranked, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_first()], {"caps_to": F.col("cap"), "w_to": F.col("w")}))
    whole = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    total, w_after = F.lit(share * whole["size"]), F.greatest(F.lit(whole["w"]) - F.col("w_to"), F.lit(0.0))
    at_cap = F.col("caps_to") + F.col("cap") / F.col("w") * w_after
    level = (total - (F.col("caps_to") - F.col("cap"))) / (w_after + F.col("w"))
    # Of sources that fill up at the same level none is full below it, as the first of them in order has it.
    reached = F.when(at_cap >= total * (1 - 1e-12), F.struct((F.col("cap") / F.col("w")).alias("at"), (-level).alias("less")))
    found = filled.agg(F.min(reached)["less"]).first()[0]
    target = F.least(F.col("cap"), F.coalesce(-F.lit(found).cast("double"), F.col("cap") / F.col("w")) * F.col("w"))
    return filled.select("source", "source_size", "documents", target.alias("target"))


_UNIT = "unit:struct<key:bigint,rows:bigint,whole:bigint>"


def _fold(items: Column) -> Column:
    """``struct(done array<struct<doc_id,size,bit,unit>>, left struct)`` of an ordered array of ``struct(h, doc_id, size, p, unit)``."""
    nobody = F.lit(None).cast(f"struct<h:bigint,doc_id:bigint,size:bigint,p:double,{_UNIT}>")
    start = F.struct(F.lit(None).cast(f"array<struct<doc_id:bigint,size:bigint,bit:int,{_UNIT}>>").alias("done"), nobody.alias("left"))
    start = F.struct(F.coalesce(start["done"], F.array().cast(f"array<struct<doc_id:bigint,size:bigint,bit:int,{_UNIT}>>")).alias("done"), start["left"].alias("left"))

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"), x["unit"].alias("unit"))

    def after(done: Column, decided: Column, bit: int, left: Column) -> Column:
        out = F.struct(decided["doc_id"].alias("doc_id"), decided["size"].alias("size"), F.lit(bit).alias("bit"), decided["unit"].alias("unit"))
        return F.struct(F.concat(done, F.array(out)).alias("done"), left.alias("left"))

    def step(state: Column, b: Column) -> Column:
        a, done = state["left"], state["done"]

        def exchange(v: Column) -> Column:
            gives = v["a_has"] <= v["b_room"]
            takes = v["b_has"] <= v["a_room"]
            first = F.when(gives, after(done, a, 0, item(b, b["p"] + v["a_has"] / b["size"]))).otherwise(after(done, b, 1, item(a, a["p"] - v["b_room"] / a["size"])))
            second = F.when(takes, after(done, b, 0, item(a, a["p"] + v["b_has"] / a["size"]))).otherwise(after(done, a, 1, item(b, b["p"] - v["a_room"] / b["size"])))
            forth, back = F.least(v["a_has"], v["b_room"]), F.least(v["b_has"], v["a_room"])
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), a["h"], b["h"], a["doc_id"], b["doc_id"]), 11) * F.lit(2.0**-53)
            return F.when(draw * (forth + back) < back, first).otherwise(second)

        amounts = F.struct(
            (a["p"] * a["size"]).alias("a_has"),
            (b["p"] * b["size"]).alias("b_has"),
            ((1 - a["p"]) * a["size"]).alias("a_room"),
            ((1 - b["p"]) * b["size"]).alias("b_room"),
        )
        return F.when(a.isNull(), F.struct(done.alias("done"), item(b, b["p"]).alias("left"))).otherwise(let(amounts, exchange))

    return F.aggregate(items, start, step)


def decide(docs: DataFrame, key: Column, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(doc_id, key, size, rows, source_size, target, copies)``: the copies all rows of a unit get together.

    Rows of equal id, source, size and ``key`` are a unit.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), key.alias("key"))
    units = checkpoint(sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows")).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "size")))
    # Units of one id and size are told apart by their key; the others don't depend on it.
    alike = checkpoint(units.groupBy(F.col("h").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if alike.limit(1).count():
        told = spread_join(units, alike.select(F.col("key").alias("of_h")), "h", "of_h", "left", counts=alike)
        units = checkpoint(told.withColumn("h", F.when(F.col("of_h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "key"))).drop("of_h"))
    targets = checkpoint(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most))
    largest = targets.agg(F.max("documents")).first()[0] or 0
    named = F.concat(F.when(F.col("source").isNull(), "").otherwise("s"), F.coalesce("source", F.lit("")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.when(F.col("size") > 0, rate).otherwise(1.0) * F.col("rows")
    own = spread_join(units.withColumn("of", named).drop("source"), targets.withColumn("named", named).drop("source"), "of", "named", counts=targets.select(named.alias("key"), F.col("documents").alias("n")))
    own = own.select("h", "doc_id", "key", "size", "rows", "source_size", "target", "documents", "named", F.floor(expected).alias("whole"), (expected - F.floor(expected)).alias("p"))
    undecided = (F.col("size") > 0) & (F.col("p") > 0)
    source = ["named", "source_size", "target"]
    kept = ["key", "rows", "whole"]
    blocks = F.ceil(F.col("documents") / BLOCK)
    level = own.filter(undecided).select(*source, F.pmod("h", blocks).alias("block"), F.struct("h", "doc_id", "size", "p", F.struct(*kept).alias("unit")).alias("x"))

    def rows(df: DataFrame, unit: Column, doc_id: Column, size: Column, bit: Column) -> DataFrame:
        return df.select(doc_id.alias("doc_id"), unit["key"].alias("key"), size.alias("size"), unit["rows"].alias("rows"), "source_size", "target", (unit["whole"] + bit).alias("copies"))

    out = rows(own.filter(~undecided), F.struct(*kept), F.col("doc_id"), F.col("size"), F.lit(0))
    first, count = True, -(-largest // BLOCK)
    while True:
        folded = level.groupBy(*source, "block").agg(F.array_sort(F.collect_list("x")).alias("items")).select(*source, "block", _fold(F.col("items")).alias("f"))
        if first:
            folded, first = checkpoint(folded), False
        done = folded.select(*source, F.explode("f.done").alias("d"))
        out = out.union(rows(done, F.col("d.unit"), F.col("d.doc_id"), F.col("d.size"), F.col("d.bit")))
        if count <= 1:
            x = F.col("f.left")
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), x["h"], x["doc_id"]), 11) * F.lit(2.0**-53)
            return out.union(rows(folded.filter(x.isNotNull()), x["unit"], x["doc_id"], x["size"], (draw < x["p"]).cast("int")))
        count = -(-count // BLOCK)
        level = folded.filter(F.col("f.left").isNotNull()).select(*source, F.floor(F.col("block") / BLOCK).alias("block"), F.col("f.left").alias("x"))


def times(df: DataFrame, number: Column, name: str) -> DataFrame:
    """Each row as often as ``number`` says, ``name`` counting from 0; never more than CHUNK numbers in one row."""
    part = fresh(f"{name}_part", df.columns)
    parts = df.filter(number > 0).withColumn(part, F.explode(F.sequence(F.lit(0), F.floor((number - 1) / CHUNK).cast("long"))))
    return parts.withColumn(name, F.explode(F.sequence(F.col(part) * CHUNK, F.least((F.col(part) + 1) * CHUNK, number.cast("long")) - 1))).drop(part)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)``, a row a document."""
    each = times(decide(docs, F.lit(0).cast("long"), weights, share, most), F.col("rows"), "place")
    copies = (F.floor(F.col("copies") / F.col("rows")) + (F.col("place") < F.col("copies") % F.col("rows")).cast("long")).cast("int")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def take(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows of size 0 once.

    Rows are told by their id and a hash of all their columns, so rows that share an id (or have none)
    get their own copies; wholly equal rows are a unit, and come out as often as it is taken.
    """
    columns = [F.to_json(F.map_entries(F.col(f"`{f.name}`"))) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema.fields]
    key = F.xxhash64(*columns)
    decided = decide(docs, key, weights, share, most)
    counts = checkpoint(decided.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("of_id"), F.col("key").alias("of_key"), "rows", "copies"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("id"), key.alias("key"))
    joined = packed.join(counts.filter("copies > 0"), (F.col("id") == F.col("of_id")) & (F.col("key") == F.col("of_key")))
    out = times(joined.filter("rows = 1"), F.col("copies"), "place").select("row.*")
    if counts.filter("rows > 1").limit(1).count():
        out = out.union(times(joined.filter("rows > 1").dropDuplicates(["id", "key"]), F.col("copies"), "place").select("row.*"))
    return out


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")
