"""Scalar helpers: arrays, headers, codecs, probabilities, formats, numbers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def number_array(text: Column, separator: str = ",", kind: str = "double") -> Column:
    """Numbers between separators; null where a part is none."""
    return F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast(kind))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def array_percentile(values: Column, share: float) -> Column:
    """The value at ``floor(share * (n - 1))`` of the sorted array."""
    return F.get(F.array_sort(values), F.floor(F.lit(share) * (F.size(values) - 1)).cast("int"))


def counts_map(values: Column) -> Column:
    """``map<value, how often>``."""
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint > 0, F.size(F.array_intersect(a, b)) / joint).otherwise(0.0)


def packed_reverse_complement(key: Column, k: int) -> Column:
    return S.packed_kmer(S.reverse_complement(S.unpacked_kmer(key, k)))


def illumina_header(name: Column) -> Column:
    """``struct(instrument, run, flowcell, lane, tile, x, y, pair, passed, barcode)`` of ``a:1:f:2:1101:10:20 1:N:0:ACGT``; nulls where a part is missing."""
    place, note = F.split(F.split_part(name, F.lit(" "), F.lit(1)), ":"), F.split(F.split_part(name, F.lit(" "), F.lit(2)), ":")
    at = lambda parts, i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    whole = {"lane": 3, "tile": 4, "x": 5, "y": 6}
    fields = [at(place, i).alias(c) for i, c in enumerate(("instrument", "run", "flowcell"))] + [at(place, i).try_cast("int").alias(c) for c, i in whole.items()]
    return F.struct(*fields, at(note, 0).try_cast("int").alias("pair"), (at(note, 1) == "N").alias("passed"), at(note, 3).alias("barcode"))


def tile_surface(tile: Column) -> Column:
    """``top`` or ``bottom``: the first digit of the tile's number."""
    return F.when(F.substring(tile.cast("string"), 1, 1) == "1", "top").otherwise("bottom")


def pacbio_header(name: Column) -> Column:
    """``struct(movie, zmw, start, stop)`` of ``movie/zmw/start_stop``."""
    part = lambda i: F.split_part(name, F.lit("/"), F.lit(i))
    span = F.split(part(3), "_")
    return F.struct(part(1).alias("movie"), part(2).try_cast("long").alias("zmw"), F.get(span, F.lit(0)).try_cast("int").alias("start"), F.get(span, F.lit(1)).try_cast("int").alias("stop"))


def encoded_fields(fields: dict[str, Column]) -> Column:
    """``name=value`` with ``%``, ``;`` and ``=`` of values escaped, put together by ``;``."""
    escaped = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit("="), F.lit("%3D"))
    return F.concat_ws(";", *[F.concat(F.lit(f"{name}="), escaped(c)) for name, c in fields.items()])


def decoded_field(text: Column, name: str) -> Column:
    raw = F.element_at(F.str_to_map(text, F.lit(";"), F.lit("=")), name)
    return F.replace(F.replace(F.replace(raw, F.lit("%3D"), F.lit("=")), F.lit("%3B"), F.lit(";")), F.lit("%25"), F.lit("%"))


def balance_probability(k: Column, n: Column) -> Column:
    """Chance that of n fair draws one side has at most ``min(k, n - k)``, both sides counted, 1 at most: how likely a strand bias at least this large is."""
    few = F.least(k, n - k)

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    one = F.pow(F.lit(0.5), n)
    start = F.struct(one.alias("term"), one.alias("sum"))
    steps = F.when(few >= 1, F.sequence(F.lit(1).cast("long"), few.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda s: s["sum"]))


def homopolymer_context(bases: Column, at: Column) -> Column:
    """Length of the run of one symbol around a place (from 0)."""
    symbol = F.substring(bases, at + 1, F.lit(1))
    run = lambda text: F.length(text) - F.length(F.ltrim(text, symbol))
    return run(F.substring(bases, at + 1, F.length(bases))) + run(F.reverse(F.substring(bases, F.lit(1), at)))


def strandedness(plus: Column, minus: Column) -> Column:
    """1 for counts on one strand alone, 0.5 for even ones; null without any."""
    return F.when(plus + minus > 0, F.greatest(plus, minus) / (plus + minus))


def size_from_sketch(keys: Column, largest: Column, space: float) -> Column:
    """Distinct keys a sketch of the ``keys`` least hashes stands for, from the largest of them in a hash space."""
    return F.when(largest > 0, F.ceil((keys - 1) * F.lit(space) / largest))


# Digits of the base-48 codec, by value.
DIGITS48 = "".join(chr(48 + i) for i in range(48))


def encoded48(number: Column) -> Column:
    """A number of at least 0 in base 48, highest digit first, digits from character 48 on."""
    places = F.sequence(F.lit(11), F.lit(0), F.lit(-1))
    whole, unit = number.cast("decimal(38,0)"), lambda i: F.pow(F.lit(48), i).cast("decimal(38,0)")
    digit = lambda i: ((whole - whole % unit(i)) / unit(i)).cast("decimal(38,0)") % 48  # noqa: E731 - without its remainder first: a decimal quotient is rounded
    text = F.array_join(F.transform(places, lambda i: F.char(digit(i).cast("int") + 48)), "")
    return F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))


def decoded48(text: Column) -> Column:
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * 48 + F.ascii(c) - 48)


def short_number(value: Column, digits: int = 2) -> Column:
    """With k, m, g or t."""
    scaled = lambda by, suffix: F.concat(F.call_function("format_number", value / F.lit(float(by)), F.lit(f"0.{'0' * digits}")), F.lit(suffix))
    return F.when(value >= 1e12, scaled(1e12, "t")).when(value >= 1e9, scaled(1e9, "g")).when(value >= 1e6, scaled(1e6, "m")).when(value >= 1e3, scaled(1e3, "k")).otherwise(scaled(1, ""))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.concat(F.call_function("format_number", 100 * part / whole, F.lit(f"0.{'0' * digits}")), F.lit("%")))


def middle(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def is_prime(n: Column) -> Column:
    """For numbers up to a few millions: tried by every number up to the root."""
    tries = F.when(n >= 4, F.sequence(F.lit(2).cast("long"), F.floor(F.sqrt(n)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return (n >= 2) & ~F.exists(tries, lambda d: n % d == 0)


# --- edits of symbols -----------------------------------------------------------


def iupac_to_n(bases: Column) -> Column:
    return F.regexp_replace(bases, "[^ACGTNacgtn]", "N")


def u_to_t(bases: Column) -> Column:
    return F.translate(bases, "Uu", "Tt")


def remapped(bases: Column, old: str, new: str) -> Column:
    return F.translate(bases, old, new)


def padded(bases: Column, left: int = 0, right: int = 0, symbol: str = "N") -> Column:
    return F.concat(F.lit(symbol * left), bases, F.lit(symbol * right))


def is_junk(bases: Column, symbols: str = "ACGTUNRYSWKMBDHV.-") -> Column:
    """Whether a sequence holds a symbol that is none."""
    return F.length(F.translate(F.upper(bases), symbols, "")) > 0


def without_junk(bases: Column) -> Column:
    return F.regexp_replace(bases, r"[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv.\-]", "N")


def polymer_length(bases: Column, symbol: str, end: str = "tail", wrong: int = 0) -> Column:
    """Length of the run of a symbol at the head or tail; with ``wrong`` the longest end with at most so many others, itself ending in the symbol."""
    text = F.reverse(bases) if end == "tail" else bases
    run = rf"(?:[^{symbol}]?{symbol}+)"
    pattern = f"^{symbol}+" if not wrong else f"^{symbol}+{run}{{0,{wrong}}}"
    return F.length(F.regexp_extract(text, pattern, 0))


def trimmed_polymer(bases: Column, symbol: str, least: int, end: str = "tail", wrong: int = 0) -> Column:
    n = polymer_length(bases, symbol, end, wrong)
    cut = F.when(n >= least, n).otherwise(0)
    return F.substring(bases, F.lit(1), F.length(bases) - cut) if end == "tail" else F.substring(bases, cut + 1, F.length(bases))


def clean_header(name: Column) -> Column:
    """White space and symbols that file names can't hold become ``_``, runs of them one."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._:+|-]+", "_")
