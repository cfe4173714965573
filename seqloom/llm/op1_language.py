"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are put together for each row: the text's likelihood in each
language, the language its markup declares, the suffix of its address, and a prior of
its host. Text likelihoods come from hashed character trigrams of labelled documents
(naive Bayes, tempered, as neighbouring trigrams aren't independent). Everything else
is learnt from the rows themselves by grouped aggregation of the text posteriors: how
often each declared value and each suffix goes with each language, and what a host's
other rows are. The host's prior is smoothed towards its site's, that towards the
whole table's; a row's own posterior is taken out of the sums it meets.

The text models are trained on a bounded sample, ``max_documents`` labelled documents
by hash of the id. All counts cover all rows.

Defined results: null and empty texts have no text evidence and are judged by the
rest; a row without any evidence gets the table's commonest language. Null, empty or
malformed addresses and missing declarations are no evidence. Without a labelled
document the language is null. Repeated rows are rows of their own; ties between
languages go to the first by name. Empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import checkpoint, map_batches, spread_join, table, texts_of

BUCKETS = 1 << 16
#: A text of n trigrams counts as n ** TEMPER independent ones.
TEMPER = 0.6
#: Pseudo-counts of the level above in the host's and the site's prior, and of evidence tables.
HOST_WEIGHT, SITE_WEIGHT, EVIDENCE_WEIGHT = 5.0, 20.0, 1.0

_HIDDEN = re.compile(r"<(script|style|title|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible(page: str) -> str:
    import html

    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def trigrams(text: str) -> np.ndarray:
    """Hash bucket of each run of three lower-cased characters, white space runs and the ends being one space."""
    plain = " " + " ".join(text.lower().split()) + " "
    if len(plain) < 3:
        return np.zeros(0, np.int64)
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, max_documents: int = 4096) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket in each."""
    chosen = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").select("lang", "text")  # max_documents rows at most

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
            rows = [(lang, int(b), float(s[b])) for lang, s in sums.items() for b in np.flatnonzero(s)]
            langs, buckets, counts = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "bucket": pa.array(buckets, pa.int32()), "n": pa.array(counts, pa.float64())})

        return run

    counted = map_batches(sample, make, "lang string, bucket int, n double", rows=256).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect()  # BUCKETS numbers a language
    languages = sorted(r.lang for r in found)
    logs = np.zeros((BUCKETS, len(languages)), np.float32)
    for r in found:
        counts = np.full(BUCKETS, 0.5)
        counts[r.b] += r.n
        logs[:, languages.index(r.lang)] = np.log(counts / counts.sum())
    return languages, logs


def likelihoods(rows: DataFrame, languages: list[str], logs: np.ndarray, html_column: str | None, carry: list[str]) -> DataFrame:
    """``(carried columns, ll array<double>)``: tempered log likelihoods of ``_text``."""
    shared = rows.sparkSession.sparkContext.broadcast(logs)  # BUCKETS numbers a language
    as_html = html_column is not None

    def make():
        logs = shared.value

        def score(text: str) -> list[float]:
            at = trigrams(visible(text) if as_html else text)
            if not len(at):
                return [0.0] * logs.shape[1]
            total = sum(logs[at[i : i + 1_000_000]].sum(0, dtype=np.float64) for i in range(0, len(at), 1_000_000))
            return ((total - total.max()) * len(at) ** (TEMPER - 1)).tolist()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = {c: batch.column(i) for i, c in enumerate(carry)}
            return pa.RecordBatch.from_pydict({**columns, "ll": pa.array([score(t) for t in texts_of(batch.column(len(carry)))], pa.list_(pa.float64()))})

        return run

    plain = rows.select(*carry, F.col("_text").cast("string"))
    return map_batches(plain, make, plain.drop("_text").schema.add("ll", T.ArrayType(T.DoubleType())), rows=128)


def softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _sums(prefix: str, n: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"{prefix}{i}") for i in range(n)]


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds ``lang`` and ``confidence`` to rows with ``ll, host, site, suffix, declared``."""
    n = len(languages)
    rows = checkpoint(rows.withColumn("p", softmax(F.col("ll"))))
    whole = rows.agg(*_sums("g", n)).first()
    everything = [(x or 0.0) + 1.0 for x in whole]
    total = sum(everything)
    shares = [x / total for x in everything]
    sites = checkpoint(rows.filter("site is not null").groupBy(F.col("site").alias("_of_site")).agg(*_sums("s", n)))
    hosts = checkpoint(rows.filter("host is not null").groupBy(F.col("host").alias("_host")).agg(F.first("site").alias("_site"), *_sums("h", n)))
    hosts = checkpoint(spread_join(hosts, sites, "_site", "_of_site", "left").drop("_site", "_of_site"))
    suffixes = rows.filter("suffix is not null").groupBy(F.col("suffix").alias("_suffix")).agg(*_sums("u", n))
    declared = rows.filter("declared is not null").groupBy(F.col("declared").alias("_declared")).agg(*_sums("d", n))
    joined = rows
    for own, sums in (("host", hosts), ("suffix", checkpoint(suffixes)), ("declared", checkpoint(declared))):
        counts = rows.groupBy(F.col(own).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        joined = spread_join(joined, sums, own, f"_{own}", "left", counts)  # one host, suffix or language may be that of most rows

    def without_own(name: str) -> list[Column]:
        return [F.greatest(F.coalesce(F.col(f"{name}{i}") - F.col("p")[i], F.lit(0.0)), F.lit(0.0)) for i in range(n)]

    def smoothed(counts: list[Column], above: list[Column], weight: float) -> list[Column]:
        size = sum(counts[1:], counts[0])
        return [(c + weight * a) / (size + weight) for c, a in zip(counts, above, strict=True)]

    prior = smoothed(without_own("h"), smoothed(without_own("s"), [F.lit(x) for x in shares], SITE_WEIGHT), HOST_WEIGHT)
    # log P(evidence | language) up to what is the same for all languages
    u, d = without_own("u"), without_own("d")
    scores = [F.col("ll")[i] + F.log(prior[i]) + F.log((u[i] + EVIDENCE_WEIGHT * shares[i]) / everything[i]) + F.log((d[i] + EVIDENCE_WEIGHT * shares[i]) / everything[i]) for i in range(n)]
    out = joined.withColumn("_posterior", softmax(F.array(*scores)))
    best = F.array_position("_posterior", F.array_max("_posterior")).cast("int")
    return out.select(*[c for c in rows.columns if c not in ("ll", "p")], F.element_at(F.array(*[F.lit(x) for x in languages]), best).alias("lang"), F.array_max("_posterior").alias("confidence"))


def address_parts(url: str) -> dict[str, Column]:
    """host, site (its last two labels) and suffix (the last label and, where there is one, a two-letter first step of the path)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    step = F.lower(F.regexp_extract(F.col(url), r"^[^/?#]*//[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return {"host": host, "site": F.substring_index(host, ".", -2), "suffix": F.when(host.isNotNull(), F.concat_ws("/", F.substring_index(host, ".", -1), F.when(step != "", step)))}


def declared_language(html: str) -> Column:
    """The primary subtag of the html element's lang."""
    found = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", 1))
    return F.when(found != "", found)


def identify(pages: DataFrame, docs: DataFrame, max_documents: int = 4096) -> DataFrame:
    """``(kind, doc_id, page_id, url, lang, confidence)`` for every page and every document.

    A document's host is its source; it declares nothing (its ``lang`` is what the models learn from).
    """
    none = F.lit(None).cast("string")
    of_pages = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "url", *[v.alias(k) for k, v in address_parts("url").items()], declared_language("html").alias("declared"), F.col("html").alias("_text"))
    of_docs = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), none.alias("url"), F.concat(F.lit("source:"), F.col("source")).alias("host"), none.alias("site"), none.alias("suffix"), none.alias("declared"), F.col("text").alias("_text"))
    languages, logs = train(docs, max_documents)
    carry = [c for c in of_pages.columns if c != "_text"]
    if not languages:
        return of_pages.union(of_docs).select("kind", "doc_id", "page_id", "url", none.alias("lang"), F.lit(0.0).alias("confidence"))
    rows = likelihoods(of_pages, languages, logs, "_text", carry).union(likelihoods(of_docs, languages, logs, None, carry))
    return fuse(rows, languages).select("kind", "doc_id", "page_id", "url", "lang", "confidence")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
