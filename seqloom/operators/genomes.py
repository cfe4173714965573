"""Error correction, consensus, genes, repeats, variants and made-up data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import sequence as S
from seqloom.operators import packed as P
from seqloom.operators.graphs import cut


def consensus(votes: DataFrame, key: str, pos: str, base: str, weight: str) -> DataFrame:
    """``(key, consensus, positions)``: at each place the base with most weight, the first by name of equals."""
    sums = votes.groupBy(key, pos, base).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(key, pos).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(base).alias("b"))).alias("x"))
    return best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("x.b").alias("b")))).alias("all")).select(key, F.array_join(F.transform("all", lambda x: x["b"]), "").alias("consensus"), F.size("all").alias("positions"))


def correct_errors(reads: DataFrame, id_column: str, bases: str, k: int, good: int) -> DataFrame:
    """Reads with single wrong symbols mended: where a run of k low k-mers lies behind a good one, the one symbol all of them hold is
    replaced by what makes its k-mer a good one, if exactly one symbol does.

    Equal reads are looked at once, with their number. K-mers are numbers of three bits a symbol (A, C, G, T, N, and one for all others),
    exact for k up to 21 and hashes beyond. Each place is shuffled once, by its k-mer, and only good places come back to their reads:
    what lies between two of them is the run of low ones.
    """
    own = reads.filter(F.col(bases).isNotNull()).groupBy(F.col(bases).alias("bases")).agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("bases").alias("read"), "bases", "n")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a place; a k-mer that is good within a piece needs no count of its places, these are dealt with ``n`` 0, and it adds one row of its number."""
        for batch in (x for whole in batches for x in P.pieces(whole, 1)):
            keys, rows, at = _hashed(batch.column(1), k)
            reads_, n = np.asarray(batch.column(0))[rows], np.asarray(batch.column(2))[rows]
            kinds, which = np.unique(keys, return_inverse=True)
            total = np.bincount(which, weights=n, minlength=len(kinds)).astype(np.int64)
            full = total >= good
            known = full[which]
            spread = np.where(known, (reads_ ^ (at * -7046029254386353131)), keys)
            sums = kinds[full]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[spread, sums]),
                pa.array(np.r_[reads_, np.zeros(len(sums), np.int64)]),
                pa.array(np.r_[at, np.full(len(sums), -1)].astype(np.int32)),
                pa.array(np.r_[np.where(known, 0, n), total[full]]),
            ], names=["key", "read", "at", "n"])

    placed = own.select("read", "bases", "n").mapInArrow(places, "key long, read long, at int, n long")
    deep = placed.withColumn("total", F.sum("n").over(W.partitionBy("key"))).filter((F.col("at") >= 0) & ((F.col("n") == 0) | (F.col("total") >= good)))
    marks = deep.groupBy("read").agg(F.sort_array(F.collect_list("at")).alias("good"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for read, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                here = np.r_[np.asarray(found.values), len(text.as_py()) - k + 1]
                starts = here[:-1][np.diff(here) == k + 1] + 1
                if len(starts):
                    keys = _hashed(pa.array([text.as_py()]), k)[0][starts]
                    last = _codes(text.as_py())[starts + k - 1]
                    for code, symbol in enumerate("ACGT"):
                        out[0] += [read] * len(starts)
                        out[1] += (starts + k - 1).tolist()
                        out[2] += [symbol] * len(starts)
                        out[3] += (keys - last + code).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["read", "at", "to", "key"])

    tries = cut(own.join(marks, "read").select("read", "bases", "good").mapInArrow(tried, "read long, at int, to string, key long"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in P.pieces(whole, 0)):
            keys, rows, _ = _hashed(batch.column(0), k)
            kinds, which = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(which, weights=np.asarray(batch.column(1))[rows], minlength=len(kinds)).astype(np.int64))], names=["key", "n"])

    known = own.select("bases", "n").mapInArrow(counted, "key long, n long").join(tries.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= good).select("key")
    fixes = tries.join(known, "key").groupBy("read", "at").agg(F.count(F.lit(1)).alias("ways"), F.first("to").alias("to")).filter("ways = 1")
    by_read = fixes.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("_fixes")).withColumnRenamed("read", "_read")
    mended = F.aggregate(F.coalesce("_fixes", F.array().cast("array<struct<at:int,to:string>>")), F.col(bases), lambda s, x: F.overlay(s, x["to"], x["at"] + 1, F.lit(1)))
    return reads.join(by_read, F.xxhash64(bases) == F.col("_read"), "left").withColumn("fixed", F.coalesce(F.size("_fixes"), F.lit(0))).withColumn(bases, mended).drop("_fixes", "_read")


_CODE = np.full(256, 5, np.int64)
_CODE[np.frombuffer(b"ACGTN", np.uint8)] = range(5)
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[np.frombuffer(S.SYMBOLS.encode(), np.uint8)] = np.frombuffer(S.COMPLEMENTS.encode(), np.uint8)


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each text starts, and the end); nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts = ends - ends[0]
    if len(raw) and raw.max() > 127:
        return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4"), np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][starts]
    return raw, starts


def _complement(raw: np.ndarray) -> np.ndarray:
    return np.where(raw < 256, _OTHER[np.minimum(raw, 255)], raw)


def palindromes(reads: DataFrame, id_column: str, bases: str, size: int) -> DataFrame:
    """``(id, pos)`` of runs of ``size`` symbols that are their own reverse complement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in P.pieces(whole, 1)):
            raw, starts = _symbols(batch.column(1))
            n = max(0, len(raw) - size + 1)
            row, other = np.repeat(np.arange(batch.num_rows), np.diff(starts)), _complement(raw)
            at = np.flatnonzero(row[:n] == row[size - 1 :][:n])
            for i in range(size):
                at = at[(raw[at + i] == other[at + size - 1 - i]) & (raw[at + i] != ord("N"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array((at - starts[row[at]]).astype(np.int32))], names=[id_column, "pos"])

    return reads.select(id_column, bases).mapInArrow(run, T.StructType([reads.schema[id_column], T.StructField("pos", T.IntegerType())]))


_LETTERS = sorted(set(S.CODE)) + ["X"]
_AMINO = np.full(6**3, len(_LETTERS) - 1, np.int64)
for _i, _c in enumerate(S.CODE):
    _AMINO[sum("ACGT".index(x) * 6**j for j, x in zip((2, 1, 0), S._CODONS[_i], strict=True))] = _LETTERS.index(_c)


def _aminos(raw: np.ndarray) -> np.ndarray:
    """The letter of the codon that begins at each place, as its number."""
    code = _CODE[np.minimum(raw, 255)]
    n = max(0, len(raw) - 2)
    return _AMINO[code[:n] * 36 + code[1 : n + 1] * 6 + code[2 : n + 2]]


def six_frames(reads: DataFrame, id_column: str, bases: str) -> DataFrame:
    """``(id, frame, amino)``: frames 0 to 2 forward, 3 to 5 of the reverse complement; X for codons with other symbols, null texts are null."""
    letters = np.frombuffer("".join(_LETTERS).encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in P.pieces(whole, 1)):
            raw, starts = _symbols(batch.column(1))
            there = batch.column(1).is_valid().to_pylist()
            both = letters[_aminos(raw)], letters[_aminos(_complement(raw[::-1]))]
            texts = []
            for i in range(batch.num_rows):
                for strand, a, b in ((0, starts[i], starts[i + 1]), (1, len(raw) - starts[i + 1], len(raw) - starts[i])):
                    texts += [both[strand][a + f : max(a + f, b - 2) : 3].tobytes().decode() if there[i] else None for f in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), 6))), pa.array(np.tile(np.arange(6, dtype=np.int32), batch.num_rows)), pa.array(texts, pa.string())], names=[id_column, "frame", "amino"])

    return reads.select(id_column, bases).mapInArrow(run, T.StructType([reads.schema[id_column], T.StructField("frame", T.IntegerType()), T.StructField("amino", T.StringType())]))


def protein_words(reads: DataFrame, id_column: str, bases: str, k: int, six: bool = True) -> DataFrame:
    """``(id, word)``: the distinct runs of k amino acids without X of each read, as numbers: of all six frames, or of the first alone."""
    n = len(_LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in P.pieces(whole, 1)):
            raw, starts = _symbols(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            found = []
            for turned in (False, True)[: 1 + six]:
                own, of = (_complement(raw[::-1]), row[::-1]) if turned else (raw, row)
                amino, many = _aminos(own), max(0, len(own) - 3 * k + 1)
                at = np.flatnonzero(of[:many] == of[3 * k - 1 :][:many])
                if not six:
                    at = at[(at - starts[of[at]]) % 3 == 0]
                word = np.zeros(len(at), np.int64)
                for i in range(k):
                    here = amino[at + 3 * i]
                    word = np.where((word < 0) | (here == n - 1), -1, word * n + here)
                found.append(of[at][word >= 0] * n**k + word[word >= 0])
            both = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both // n**k)), pa.array(both % n**k)], names=[id_column, "word"])

    return reads.select(id_column, bases).mapInArrow(run, T.StructType([reads.schema[id_column], T.StructField("word", T.LongType())]))


def _codes(text: str) -> np.ndarray:
    return _CODE[np.minimum(_symbols(pa.array([text]))[0], 255)]


def _hashed(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, places) of every k symbols; a key without its last code is the same for all last symbols."""
    raw, starts = _symbols(texts)
    n = len(raw) - k + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    base = 8 if k <= 21 else 6364136223846793005
    code, keys = _CODE[np.minimum(raw, 255)], np.zeros(n, np.int64)
    for i in range(k):
        keys = keys * base + code[i : i + n]
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return keys[at], row[at], at - starts[row[at]]


def open_frames(contigs: DataFrame, id_column: str, bases: str, least: int) -> DataFrame:
    """``(id, strand, start, stop, length)``: ATG to the first stop codon in frame, both strands, longest of each stop; strand coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in P.pieces(whole, 1)):
            raw, starts = _symbols(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            for strand in "+-":
                if strand == "-":
                    raw, starts, row = _complement(raw[::-1]), len(raw) - starts[::-1], batch.num_rows - 1 - row[::-1]
                rows, start, stop = _frames(raw, row, starts)
                if strand == "-":
                    rows = batch.num_rows - 1 - rows
                wide = stop - start >= least
                rows, start, stop = rows[wide], start[wide], stop[wide]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.repeat(pa.scalar(strand), len(rows)), *[pa.array(x.astype(np.int32)) for x in (start, stop, stop - start)]], names=[id_column, "strand", "start", "stop", "length"])

    schema = T.StructType([contigs.schema[id_column], T.StructField("strand", T.StringType()), *[T.StructField(x, T.IntegerType()) for x in ("start", "stop", "length")]])
    return contigs.select(id_column, bases).mapInArrow(run, schema)


def _frames(raw: np.ndarray, row: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, stops) of open frames of rows one behind the other, each row and frame walked by sorted places of its ATG and stop codons."""
    n = len(raw) - 2
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    is_, inside = (lambda i, c: raw[i : i + n] == ord(c)), row[:n] == row[2:]
    opens = is_(0, "A") & is_(1, "T") & is_(2, "G") & inside
    ends = is_(0, "T") & ((is_(1, "A") & (is_(2, "A") | is_(2, "G"))) | (is_(1, "G") & is_(2, "A"))) & inside
    at = np.flatnonzero(opens | ends)
    place, walk = at - starts[row[at]], row[at] * 3 + (at - starts[row[at]]) % 3
    order = np.lexsort((place, walk))
    at, place, walk = at[order], place[order], walk[order]
    last = ends[at]
    first = np.r_[True, (walk[1:] != walk[:-1]) | last[:-1]] if len(at) else np.zeros(0, bool)  # each part begins behind a stop, or with its frame
    begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    done = np.flatnonzero(last & ~first)
    return walk[done] // 3, place[begin[done]], place[done] + 3


def tandem_repeats(rows: DataFrame, id_column: str, bases: str, unit: int, copies: int) -> DataFrame:
    """``(id, unit, found)``: units of a length that stand ``copies`` times or more in a row."""
    pattern = rf"((?:(.{{{unit}}})\2{{{copies - 1},}}))"
    return rows.select(id_column, F.explode(F.regexp_extract_all(F.col(bases), F.lit(pattern), F.lit(1))).alias("run")).groupBy(id_column, F.substring("run", 1, unit).alias("unit")).agg(F.count(F.lit(1)).alias("found"))


def normalise_variant(pos: Column, ref: Column, alt: Column) -> Column:
    """``struct(pos, ref, alt)`` without shared symbols at the end, then at the start; one symbol of each is left."""
    def common(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b)) - 1
        return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(s))

    back = common(F.reverse(ref), F.reverse(alt))
    r, a = F.substring(ref, F.lit(1), F.length(ref) - back), F.substring(alt, F.lit(1), F.length(alt) - back)
    front = common(r, a)
    return F.struct((pos + front).alias("pos"), F.substring(r, front + 1, F.length(r)).alias("ref"), F.substring(a, front + 1, F.length(a)).alias("alt"))


def split_alleles(variants: DataFrame, alt: str = "alt") -> DataFrame:
    """A row an allele, ``allele`` from 1."""
    out = variants.select("*", F.posexplode(F.split(alt, ",")).alias("allele", "_alt"))
    return out.withColumn(alt, F.col("_alt")).withColumn("allele", F.col("allele") + 1).drop("_alt")


def apply_variants(contigs: DataFrame, variants: DataFrame, key: str, bases: str) -> DataFrame:
    """Contigs with non-overlapping variants ``(key, pos from 1, ref, alt, depth)`` put in; of overlapping ones the deepest in turn stays."""
    one = variants.groupBy(key, "pos").agg(F.max(F.struct("depth", "ref", "alt")).alias("v")).select(key, "pos", "v.*")
    listed = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "pos", "ref", "alt"))).alias("_v"))
    start = F.array().cast("array<struct<d:bigint,pos:int,ref:string,alt:string>>")
    clear = lambda kept, v: ~F.exists(kept, lambda k: (k["pos"] < v["pos"] + F.length(v["ref"])) & (v["pos"] < k["pos"] + F.length(k["ref"])))
    kept = F.aggregate(F.coalesce(F.col("_v").cast("array<struct<d:bigint,pos:int,ref:string,alt:string>>"), start), start, lambda s, v: F.when(clear(s, v), F.concat(s, F.array(v))).otherwise(s))
    backwards = F.reverse(F.array_sort(F.transform(kept, lambda v: F.struct(v["pos"].alias("pos"), v["ref"].alias("ref"), v["alt"].alias("alt")))))
    put = F.aggregate(backwards, F.col(bases), lambda s, v: F.overlay(s, v["alt"], v["pos"], F.length(v["ref"])))
    return contigs.join(listed, key, "left").withColumn("applied", F.size(kept)).withColumn(bases, put).drop("_v")


def synthetic_reads(spark, n: int, length: int, seed: int = 0) -> DataFrame:
    """``(id, bases, quals)`` of n random reads; a row's content hangs on its number alone, so any partitioning gives the same."""
    def letter(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.pmod(F.xxhash64(F.lit(seed), F.col("n"), i), F.lit(4)) + 1).cast("int"))

    places = F.sequence(F.lit(1), F.lit(length))
    return spark.range(n).withColumnRenamed("id", "n").select(F.concat(F.lit("r"), "n").alias("id"), F.array_join(F.transform(places, letter), "").alias("bases"), F.transform(places, lambda i: (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("n"), i), F.lit(40)) + 1).cast("int")).alias("quals"))


def mutate(rows: DataFrame, bases: str, rate: float, seed: int = 0) -> DataFrame:
    """Substitutions at a rate, decided by a hash of the sequence and the place."""
    def changed(b: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            h = F.pmod(F.xxhash64(b, i, F.lit(seed)), F.lit(1_000_000))
            return F.when(h < int(rate * 1_000_000), F.translate(c, "ACGT", "CGTA")).otherwise(c)

        return F.array_join(F.transform(F.split(b, ""), one), "")

    return rows.withColumn(bases, S.let(F.col(bases), changed))


def network(features: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """A small feed-forward network's outputs (tanh inside, logistic at the end) as one expression."""
    out = features
    for k, (weights, biases) in enumerate(layers):
        def unit(row: list[float], bias: float, x: Column = out) -> Column:
            return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)

        last = k == len(layers) - 1
        values = [unit(r, b) for r, b in zip(weights, biases, strict=True)]
        out = F.array(*[1 / (1 + F.exp(-v)) if last else F.tanh(v) for v in values])
    return out
