import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import op7_bpe as op

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return op.ByteBpe(PATH, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aab e'stré \n\t!=-<|endoftext|>"))))
def test_as_the_library(library, own, text):
    ids = list(struct.unpack(f"<{len(own.encode(text)) // 4}I", own.encode(text)))
    assert ids == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()
    assert len(own.offsets(text)) == len(ids)


def test_split_characters(own):
    spans = own.offsets("a\U0001f9ff")
    assert spans[0] == (0, 1) and set(spans[1:]) == {(1, 2)} and len(spans) > 2


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op.op7_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, docs, library, monkeypatch):
    monkeypatch.setattr(op, "AT_ONCE", 50)
    long = "wörter und a b " * 5000
    got = {r.doc_id: r for r in op.digests(docs([(1, None, None), (2, "", None), (None, "x", None), (3, long, None)])).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_tokens == len(library.encode_ordinary(long)) and got[None].n_tokens == 1
    assert op.digests(docs([])).collect() == []
    back = {r.doc_id: r.decoded for r in op.decode(op.encode(docs(["né", None]), offsets=True)).collect()}
    assert back == {0: "né".encode(), 1: b""}
