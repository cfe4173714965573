"""Column expressions over sequence strings, quality arrays and headers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbols and their complements, IUPAC codes included.
SYMBOLS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENTS = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
MOST = 2**31 - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda: there Spark would compute a derived column again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """A derived column for ``select`` that is computed once a row, whatever uses it: filters and projections don't pass a generator, so Catalyst can't copy the expression into each use."""
    return F.explode(F.array(value))


def complement(bases: Column) -> Column:
    return F.translate(bases, SYMBOLS, COMPLEMENTS)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def canonical(kmer: Column) -> Column:
    """The larger of the two strands."""
    return F.greatest(kmer, reverse_complement(kmer))


def count_of(bases: Column, symbols: str) -> Column:
    return F.length(bases) - F.length(F.translate(bases, symbols, ""))


def gc(bases: Column) -> Column:
    """Share of G and C among defined symbols; 0 without any."""
    defined = count_of(bases, "ACGTacgt")
    return F.when(defined > 0, count_of(bases, "GCgc") / defined).otherwise(F.lit(0.0))


def pieces(bases: Column, size: int, more: int = 0) -> Column:
    """The text in pieces of ``size`` symbols, each with up to ``more`` of those behind it. A substring is found by counting from the start of its text, so places deep in a long text are looked up within a piece."""
    return F.coalesce(F.regexp_extract_all(bases, F.lit(rf"(?s)(?=(.{{1,{size + more}}})).{{1,{size}}}"), F.lit(1)), F.array().cast("array<string>"))


def kmers(bases: Column, k: int, step: int = 1) -> Column:
    """Every k symbols from left to right; an empty array where there are fewer."""

    def all_of(b: Column) -> Column:
        starts = F.when(F.length(b) >= k, F.sequence(F.lit(1), F.length(b) - k + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(b, i, F.lit(k)))

    return F.flatten(F.transform(pieces(bases, step * max(1, 128 // step), k - 1), all_of))


def defined_kmers(bases: Column, k: int) -> Column:
    """The k-mers of A, C, G and T alone: those of each run of defined symbols."""
    return F.flatten(F.transform(F.split(bases, "[^ACGT]+"), lambda run: kmers(run, k)))


def packed_kmer(kmer: Column) -> Column:
    """Two bits a symbol (A 0, C 1, G 2, T 3), first symbol highest; for k up to 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpacked_kmer(key: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings of one length differ; null for other lengths."""
    letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(letters, F.lit(0), lambda s, x: s + x))


def error_of(q: Column) -> Column:
    """Error probability of a Phred quality."""
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def expected_errors(quals: Column) -> Column:
    return F.aggregate(quals, F.lit(0.0), lambda s, q: s + error_of(q))


def average_quality(quals: Column) -> Column:
    """The quality of the mean error probability."""
    return F.when(F.size(quals) > 0, -10 * F.log10(expected_errors(quals) / F.size(quals)))


def phred(text: Column, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def phred_text(quals: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(quals, lambda q: F.char(q + offset)), "")


def longest_defined_run(bases: Column) -> Column:
    return F.array_max(F.transform(F.split(bases, "[^ACGTacgt]+"), lambda x: F.length(x)))


def entropy(counts: Column, total: Column) -> Column:
    """Shannon entropy of an array of counts over the logarithm of their number; 0 where that is 0."""
    bits = F.aggregate(counts, F.lit(0.0), lambda s, n: s + F.when(n > 0, -(n / total) * F.ln(n / total)).otherwise(0.0))
    return F.when(total > 1, bits / F.ln(total)).otherwise(F.lit(0.0))


def mean_kmer_entropy(bases: Column, k: int = 1, alphabet: tuple[str, ...] = ("A", "C", "G", "T")) -> Column:
    """Entropy of a whole sequence's symbols, normalised by the logarithm of their number."""
    return let(F.array(*[count_of(bases, a) for a in alphabet]), lambda counts: entropy(counts, F.aggregate(counts, F.lit(0), lambda s, n: s + n)))


def left_trim_run(quals: Column, threshold: int, good: int = 2) -> Column:
    """How many symbols to cut on the left: up to the last bad one before ``good`` qualities in a row above the threshold."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("cut"))

    def step(s: Column, q: Column) -> Column:
        over = s["run"] >= good
        ok = q > threshold
        return F.struct((s["i"] + 1).alias("i"), F.when(over, s["run"]).when(ok, s["run"] + 1).otherwise(0).alias("run"), F.when(over | ok, s["cut"]).otherwise(s["i"] + 1).alias("cut"))

    return F.aggregate(quals, start, step, lambda s: F.when(s["run"] >= good, s["cut"]).otherwise(s["i"]))


def right_trim_run(quals: Column, threshold: int, good: int = 2) -> Column:
    return left_trim_run(F.reverse(quals), threshold, good)


def optimal_range(quals: Column, average_error: float) -> Column:
    """``struct(start, stop)``, stop exclusive: the run with the largest sum of ``average_error - error``; empty if none is above 0.

    A quality below 1 counts as an undefined symbol's error, ``max(min(1.1 * average_error, 1), 0.75)``. The longer of equal runs wins.
    """
    undefined = max(min(1.1 * average_error, 1.0), 0.75)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def step(s: Column, q: Column) -> Column:
        total = s["sum"] + F.lit(average_error) - F.when(q < 1, F.lit(undefined)).otherwise(error_of(q))
        better = (total > s["best"]) | ((total == s["best"]) & (total > 0) & (s["i"] + 1 - s["from"] > s["stop"] - s["start"]))
        dead = total < 0
        return F.struct(
            (s["i"] + 1).alias("i"),
            F.when(dead, 0.0).otherwise(total).alias("sum"),
            F.when(dead, s["i"] + 1).otherwise(s["from"]).alias("from"),
            F.when(better, total).otherwise(s["best"]).alias("best"),
            F.when(better, s["from"]).otherwise(s["start"]).alias("start"),
            F.when(better, s["i"] + 1).otherwise(s["stop"]).alias("stop"),
        )

    return F.aggregate(quals, start, step, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))


def window_trim_right(quals: Column, window: int, threshold: int) -> Column:
    """Length kept: up to the first window whose sum is under ``max(window * threshold, 1)``."""
    least = max(window * threshold, 1)

    def kept(q: Column) -> Column:
        starts = F.when(F.size(q) >= window, F.sequence(F.lit(1), F.size(q) - window + 1)).otherwise(F.array().cast("array<int>"))
        bad = F.filter(starts, lambda i: F.aggregate(F.slice(q, i, window), F.lit(0), lambda s, x: s + x) < least)
        return F.coalesce(F.get(bad, F.lit(0)) - 1, F.size(q))

    return let(quals, kept)


def trim_to(bases: Column, left: Column, right: Column) -> Column:
    """Without ``left`` symbols before and ``right`` after."""
    return F.substring(bases, left + 1, F.greatest(F.length(bases) - left - right, F.lit(0)))


def forced_right(bases: Column, to: int | None = None, off: int = 0, modulo: int = 0) -> Column:
    """Length left by forced right trims: a last position, an amount, a modulus."""
    ends = [F.length(bases) - off]
    if to is not None:
        ends.append(F.lit(to + 1))
    if modulo:
        ends.append(F.length(bases) - F.length(bases) % modulo)
    return F.greatest(F.least(*ends) if len(ends) > 1 else ends[0], F.lit(0))


def ani_from_kmer_identity(identity: Column, k: int) -> Column:
    return F.pow(identity, F.lit(1.0 / k))


# The standard genetic code, codons in order of T, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]


def translated(bases: Column, frame: int = 0) -> Column:
    """Amino acids of a reading frame (0 to 2 forward); X for codons with other symbols."""
    code = F.create_map(*[F.lit(x) for pair in zip(_CODONS, CODE, strict=True) for x in pair])

    def amino(b: Column) -> Column:
        starts = F.when(F.length(b) >= 3, F.sequence(F.lit(1), F.length(b) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(starts, lambda i: F.coalesce(F.try_element_at(code, F.substring(b, i, F.lit(3))), F.lit("X"))), "")

    return F.array_join(F.transform(pieces(F.substring(bases, 1 + frame, MOST), 126), amino), "")


def six_frames(bases: Column) -> Column:
    """``array<struct<frame, amino>>``: 0 to 2 forward, 3 to 5 of the reverse complement."""
    back = reverse_complement(bases)
    return F.array(*[F.struct(F.lit(i).alias("frame"), translated(bases if i < 3 else back, i % 3).alias("amino")) for i in range(6)])


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<len, op>>``."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("len"), F.substring(x, -1, 1).alias("op")))


def cigar_length(cigar: Column, ops: str) -> Column:
    """Summed length of the operations in ``ops``; the reference span is that of MDN=X."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.instr(F.lit(ops), x["op"]) > 0), F.lit(0), lambda s, x: s + x["len"])


def suffixed_number(text: Column) -> Column:
    """A number with a k, m, g or t suffix, decimal."""
    scale = F.create_map(*[F.lit(x) for x in ("k", 1e3, "m", 1e6, "g", 1e9, "t", 1e12, "", 1.0)])
    return F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double") * F.try_element_at(scale, F.lower(F.regexp_extract(text, r"([kKmMgGtT]?)$", 1)))


def boolean_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("t", "true", "1"), True).when(low.isin("f", "false", "0"), False)


def distance(a: Column, b: Column, kind: str) -> Column:
    """Distances of two frequency arrays: absolute, euclid, cosine, hellinger."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    if kind == "absolute":
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if kind == "euclid":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if kind == "hellinger":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0)))) / 2)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return 1 - dot / F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
