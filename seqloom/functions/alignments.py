"""Column expressions over CIGAR and MD strings: places of the operations, mismatches, edits, clips. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.sequence import cigar_length, cigar_ops, let

#: What an operation moves along: the read, the reference.
READ_OPS, REF_OPS = "MIS=X", "MDN=X"


def _moves(op: Column, ops: str) -> Column:
    return F.instr(F.lit(ops), op) > 0


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """``array<struct<op, len, read_at, ref_at>>``: read places from 0, reference places as ``pos`` counts."""
    state = F.struct(F.array().cast("array<struct<op:string,len:int,read_at:int,ref_at:int>>").alias("done"), F.lit(0).alias("read"), pos.cast("int").alias("ref"))

    def step(s: Column, x: Column) -> Column:
        block = F.struct(x["op"].alias("op"), x["len"].alias("len"), s["read"].alias("read_at"), s["ref"].alias("ref_at"))
        return F.struct(
            F.concat(s["done"], F.array(block)).alias("done"),
            (s["read"] + F.when(_moves(x["op"], READ_OPS), x["len"]).otherwise(0)).alias("read"),
            (s["ref"] + F.when(_moves(x["op"], REF_OPS), x["len"]).otherwise(0)).alias("ref"),
        )

    return F.aggregate(cigar_ops(cigar), state, step, lambda s: s["done"])


def match_string(cigar: Column) -> Column:
    """One letter a column of the alignment."""
    return F.array_join(F.transform(cigar_ops(cigar), lambda x: F.repeat(x["op"], x["len"])), "")


def cigar_of(match: Column) -> Column:
    """The CIGAR of a match string: its runs with their lengths."""
    runs = F.regexp_extract_all(match, F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def stop_of(cigar: Column, pos: Column) -> Column:
    """Behind the last reference symbol of the alignment."""
    return pos + cigar_length(cigar, REF_OPS)


def leading_clip(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))


def trailing_clip(cigar: Column) -> Column:
    return F.coalesce(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))


def unclipped(cigar: Column, pos: Column) -> Column:
    """``struct(pos, cigar)`` with soft clips made matches, as if the read had not been clipped."""
    plain = cigar_of(F.translate(match_string(cigar), "S", "M"))
    return F.struct((pos - leading_clip(cigar)).alias("pos"), plain.alias("cigar"))


def md_parts(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))


def md_events(md: Column) -> Column:
    """``array<struct<ref_off, ref, deleted>>``: mismatches and deletions, by their place from the alignment's start on the reference."""
    state = F.struct(F.array().cast("array<struct<ref_off:int,ref:string,deleted:boolean>>").alias("done"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        run, gone = x.try_cast("int"), x.startswith("^")
        ref = F.when(gone, F.substring(x, 2, 1 << 30)).otherwise(x)
        event = F.struct(s["at"].alias("ref_off"), ref.alias("ref"), gone.alias("deleted"))
        return F.struct(F.when(run.isNotNull(), s["done"]).otherwise(F.concat(s["done"], F.array(event))).alias("done"), (s["at"] + F.coalesce(run, F.length(ref))).alias("at"))

    return F.aggregate(md_parts(md), state, step, lambda s: s["done"])


def mismatches(md: Column) -> Column:
    return F.filter(md_events(md), lambda e: ~e["deleted"])


def read_place(blocks: Column, ref_at: Column) -> Column:
    """The read place aligned to a reference place; null where none is."""
    hit = F.filter(blocks, lambda b: F.instr(F.lit("M=X"), b["op"]).cast("boolean") & (b["ref_at"] <= ref_at) & (ref_at < b["ref_at"] + b["len"]))
    return F.get(hit, F.lit(0))["read_at"] + ref_at - F.get(hit, F.lit(0))["ref_at"]


def edits(cigar: Column, md: Column) -> Column:
    """``struct(subs, ins, dels, ins_events, del_events, clipped, matches, identity)``; identity is matches over matches and edits."""

    def made(x: Column) -> Column:
        whole = x["matches"] + x["subs"] + x["ins"] + x["dels"]
        return F.struct(*[x[c].alias(c) for c in ("subs", "ins", "dels", "ins_events", "del_events", "clipped", "matches")], F.when(whole > 0, x["matches"] / whole).otherwise(F.lit(0.0)).alias("identity"))

    events = lambda op: F.size(F.filter(cigar_ops(cigar), lambda x: x["op"] == op))
    subs = F.size(mismatches(md))
    counts = F.struct(
        subs.alias("subs"), cigar_length(cigar, "I").alias("ins"), cigar_length(cigar, "D").alias("dels"), events("I").alias("ins_events"), events("D").alias("del_events"),
        cigar_length(cigar, "SH").alias("clipped"), (cigar_length(cigar, "M=X") - subs).alias("matches"),
    )
    return let(counts, made)


def alleles(cigar: Column, md: Column, pos: Column, bases: Column) -> Column:
    """``array<struct<pos, kind, ref, alt>>`` of an alignment: substitutions, and insertions and deletions by the reference place before them."""

    def made(x: Column) -> Column:
        subs = F.transform(F.filter(x["events"], lambda e: ~e["deleted"]), lambda e: F.struct((x["pos"] + e["ref_off"]).alias("pos"), F.lit("sub").alias("kind"), e["ref"].alias("ref"), F.substring(x["bases"], read_place(x["blocks"], x["pos"] + e["ref_off"]) + 1, F.lit(1)).alias("alt")))
        dels = F.transform(F.filter(x["events"], lambda e: e["deleted"]), lambda e: F.struct((x["pos"] + e["ref_off"] - 1).alias("pos"), F.lit("del").alias("kind"), e["ref"].alias("ref"), F.lit("").alias("alt")))
        ins = F.transform(F.filter(x["blocks"], lambda b: b["op"] == "I"), lambda b: F.struct((b["ref_at"] - 1).alias("pos"), F.lit("ins").alias("kind"), F.lit("").alias("ref"), F.substring(x["bases"], b["read_at"] + 1, b["len"]).alias("alt")))
        return F.concat(subs, ins, dels)

    return let(F.struct(cigar_blocks(cigar, pos).alias("blocks"), md_events(md).alias("events"), pos.cast("int").alias("pos"), bases.alias("bases")), made)
