import math

from pyspark.sql import types as T

from seqloom.llm import common
from seqloom.llm import op1_language as op

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("host", T.StringType())])
TEXT = {"en": "the thing that was with this and other words ", "fr": "une chose qui est dans les autres mots que vous ", "de": "das ist nicht der einzige und andere worte "}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "zz", "hh") for r in rows], PAGES)


def test_evidence(spark):
    docs = docs_of(spark, [(i, TEXT[l] * (1 + i % 4), l, f"s{l}", 1) for i, l in enumerate(list(TEXT) * 20)])
    page = lambda text, lang=None: f"<html{f' lang={lang}' if lang else ''}><script>the the</script><p>{text}</p></html>"
    rows = [(i, f"http://{l}.example.org/x", page(TEXT[l] * 3, l)) for i, l in enumerate(list(TEXT) * 10)]
    odd = [(100, "http://fr.example.org/y", page("12345")), (101, "bad address", page(TEXT["de"] * 2)), (102, None, None), (103, "http://new.example.org/", page("", "de")), (104, "", "")]
    got = {(r.kind, r.doc_id if r.kind == "document" else r.page_id): r for r in op.identify(pages_of(spark, rows + odd), docs).collect()}
    assert len(got) == len(rows) + len(odd) + 60
    for i, l in enumerate(list(TEXT) * 10):
        assert got["page", i].lang == l
    for i, l in enumerate(list(TEXT) * 20):
        assert got["document", i].lang == l
    assert got["page", 100].lang == "fr"  # its host
    assert got["page", 101].lang == "de"  # its text
    assert got["page", 103].lang == "de"  # what it declares
    assert all(r.lang in TEXT and 0 < r.confidence <= 1 for r in got.values())


def test_brute_force_posterior(spark):
    """The fused posterior of one small table, computed by hand."""
    languages = ["a", "b"]
    ll = [[0.0, -2.0], [0.0, -1.0], [-3.0, 0.0], [0.0, 0.0]]
    host = ["h", "h", "g", None]
    rows = spark.createDataFrame([(i, x, h, "s" if h else None, None, None) for i, (x, h) in enumerate(zip(ll, host, strict=True))], "i int, ll array<double>, host string, site string, suffix string, declared string")
    got = {r.i: r for r in op.fuse(rows, languages).collect()}
    p = []
    for x in ll:
        e = [math.exp(v) for v in x]
        p.append([v / sum(e) for v in e])
    every = [sum(q[k] for q in p) + 1 for k in range(2)]
    share = [v / sum(every) for v in every]
    for i, x in enumerate(ll):
        site = [sum(p[j][k] for j in range(4) if host[j] and j != i) if host[i] else 0 for k in range(2)]
        site = [(site[k] + op.SITE_WEIGHT * share[k]) / (sum(site) + op.SITE_WEIGHT) for k in range(2)]
        own = [sum(p[j][k] for j in range(4) if host[j] == host[i] and j != i) if host[i] else 0 for k in range(2)]
        prior = [(own[k] + op.HOST_WEIGHT * site[k]) / (sum(own) + op.HOST_WEIGHT) for k in range(2)]
        score = [x[k] + math.log(prior[k]) + 2 * math.log(op.EVIDENCE_WEIGHT * share[k] / every[k]) for k in range(2)]
        e = [math.exp(v - max(score)) for v in score]
        want = [v / sum(e) for v in e]
        assert got[i].lang == languages[want.index(max(want))] and abs(got[i].confidence - max(want)) < 1e-9


def test_empty_and_unlabelled(spark):
    docs = docs_of(spark, [(1, "text", None, None, 1), (None, None, "en", None, None)])
    assert {r.lang for r in op.identify(pages_of(spark, [(1, "http://x/", "<p>x")]), docs).collect()} == {None}
    assert op.identify(pages_of(spark, []), docs_of(spark, [])).collect() == []


def test_driver_tables(spark):
    got = op.op1_language(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) + 50
    right = sum(docs[r.doc_id] == r.lang for r in rows if r.kind == "document")
    assert right >= 0.97 * len(docs)


def test_language_declared_behind_a_long_comment(spark):
    page = f"<!-- {'x' * 70000} --><html lang='fr'><body>a</body></html>"
    assert spark.createDataFrame([(page,)], "html string").select(op.declared_language("html")).first()[0] == "fr"


def test_hot_hosts_and_long_pages(spark, monkeypatch):
    """One host and one suffix hold most rows, or none is known: spreading them changes nothing. A declaration behind a long preamble counts."""
    docs = docs_of(spark, [(i, TEXT[l] * (1 + i % 4), l, "one", 1) for i, l in enumerate(list(TEXT) * 20)])
    rows = [(i, "http://big.example.org/x" if i % 3 else f"http://h{i}.example.org/", f"<p>{TEXT[l]}</p>") for i, l in enumerate(list(TEXT) * 20)] + [(200 + i, None, "<p>123</p>") for i in range(20)]
    rows += [(300, "http://big.example.org/", f"<!--{'x' * 70_000}--><html lang='de'><p>123</p>" + "<p> </p>" * 50_000)]
    one = {(r.kind, r.doc_id, r.page_id): (r.lang, round(r.confidence, 9)) for r in op.identify(pages_of(spark, rows), docs).collect()}
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    two = {(r.kind, r.doc_id, r.page_id): (r.lang, round(r.confidence, 9)) for r in op.identify(pages_of(spark, rows), docs).collect()}
    assert one == two and len(one) == len(rows) + 60
    assert pages_of(spark, rows).filter("page_id = 300").select(op.declared_language("html").alias("d")).first().d == "de"
