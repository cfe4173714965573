import json
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import op6_tokens as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces, free=""):
    """Longest match from the left, piece by piece."""
    n = at = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces or word[at:end] == free:
                n += word[at:end] != free
                at = end
                break
        else:
            return None
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcd", max_size=14))
def test_automaton(pieces, word):
    assert op.LongestMatch(sorted(pieces)).count(word) == greedy(word, pieces)
    assert op.LongestMatch(sorted(pieces), free="d").count(word) == greedy(word, pieces - {"d"}, "d")


@pytest.fixture(scope="module")
def counter():
    return op.WordCounter(PATH)


def test_query(spark, counter):
    end = "</w>"
    vocabulary = {p.removesuffix(end) + op.END if p.endswith(end) else p for p in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op.op6_tokens(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got[:60]:
        found = [w.encode().decode("latin-1").translate(counter.shown) + op.END for w in counter.matches.findall(unicodedata.normalize("NFC", texts[r.doc_id]).lower())]
        counts = [greedy(w, vocabulary, op.END) for w in found]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(found), sum(1 if c is None else c for c in counts), counts.count(None))


def test_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(op, "AT_ONCE", 50)
    got = {r.doc_id: r for r in op.token_counts(docs([(1, None, None), (2, "", None), (None, "a b", None), (3, "word " * 5000, None), (4, "x" * 30000, None)])).collect()}
    assert got[1].n_tokens == got[2].n_words == 0 and got[None].n_words == 2
    assert got[3].n_words == 5000 and got[3].n_tokens == 5000 * op.WordCounter(PATH).tokens("word") and got[4].n_words == 1
    assert op.token_counts(docs([])).collect() == []
