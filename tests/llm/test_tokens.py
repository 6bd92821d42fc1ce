"""Token counts against the tokenizer libraries, with the vocabulary of the query and with random ones that are full of ties."""

import random
import struct

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from argil.llm import token_counts
from argil.llm.token_counts import SPACE, Vocabulary


def library(v):
    """The unigram model of the tokenizers library, which adds up in double precision."""
    t = Tokenizer(models.Unigram([("<none>", 0.0), *v.pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256) if v.bytes_)], unk_id=0, byte_fallback=v.bytes_))
    return lambda x: len(t.encode(SPACE + x.replace(" ", SPACE), add_special_tokens=False).ids) if x else 0


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def fields(data):
    """Field number, wire type and payload of each field of a serialised message, and its bytes."""
    at = 0
    while at < len(data):
        begin = at

        def number():
            nonlocal at
            n = shift = 0
            while True:
                b = data[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        tag = number()
        kind = tag & 7
        size = number() if kind in (0, 2) else 4 if kind == 5 else 8
        payload = size if kind == 0 else data[at : at + size]
        at += 0 if kind == 0 else size
        yield tag >> 3, payload, data[begin:at]


def unigram(v):
    """A sentencepiece unigram model: the file's own with the scores of ``v`` and another type."""
    scores = dict(v.pieces)
    out = b""
    for n, payload, whole in fields(open(token_counts.MODEL, "rb").read()):
        if n == 1:
            own = {k: x for k, x, _ in fields(payload)}
            name = own[1].decode()
            kind = own.get(3, 1)
            body = b"\x0a" + varint(len(own[1])) + own[1] + b"\x15" + struct.pack("<f", scores[name] if kind == 1 else 0.0) + b"\x18" + varint(kind)
            whole = b"\x0a" + varint(len(body)) + body
        elif n == 2:
            body = b"".join(w for k, _, w in fields(payload) if k != 3) + b"\x18\x01"
            whole = b"\x12" + varint(len(body)) + body
        out += whole
    p = sentencepiece.SentencePieceProcessor(model_proto=out)
    return lambda x: len(p.encode(x))


REAL = Vocabulary.load(token_counts.MODEL)
LIBRARY = library(REAL)
OWN = unigram(REAL)
ODD = ["see</s>", "abc<unk>", "x<0x41>y", "<s>", "a  b   c", "  a", "a  ", " ", "    ", "a▁b", "\n\n", "a\tb\n c", "日本語", "🙂🙂 🙂", "é" * 50, "a\u0000b", "x" * 500, "the the  the"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert REAL.count(text) == OWN(text)
    assert "<0x" in text or OWN(text) == LIBRARY(text)  # where it takes bytes for pieces
    assert REAL.column(pa.array([text])).tolist() == [OWN(text)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(st.sampled_from("theing an\n▁é日 </s>"), max_size=80)))
def test_real_vocabulary(text):
    assert REAL.count(text) == LIBRARY(text)
    if "\0" not in text:
        assert REAL.count(text) == OWN(text)
    assert REAL.column(pa.array([text, None, text])).tolist() == [REAL.count(text), 0, REAL.count(text)]


def test_documents_of_the_corpus(spark):
    """Exact for every document; and how far it is from the file's own byte pair encoding, which is another tokenizer."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    merges = sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)
    rows = token_counts.count_tokens(docs.select("doc_id", "text"), REAL).collect()
    assert all(r.n_tokens == (LIBRARY(r.text) if r.text else 0) for r in rows)
    assert sum(r.n_tokens for r in rows) == pytest.approx(sum(len(merges.encode(r.text or "")) for r in rows), rel=0.03)


def test_ties():
    r = random.Random(0)
    for _ in range(200):
        pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 15))}
        v = Vocabulary([(p, -float(r.randint(1, 3))) for p in sorted(pieces)], bytes_=False)
        known = library(v)
        for _ in range(20):
            text = "".join(r.choice("abcd ") for _ in range(r.randint(0, 14)))
            assert v.count(text) == known(text), (v.pieces, text)
            assert v.column(pa.array([text])).tolist() == [known(text)]


def test_a_long_word_holds_few_states():
    assert REAL._ring <= 64
    text = "語" * 300_000
    assert REAL.count(text) == LIBRARY(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    v = Vocabulary(REAL.pieces)
    text = " ".join(f"word{i}" for i in range(100)) + " " + "x" * 1000
    assert v.column(pa.array([text])).tolist() == [LIBRARY(text)] and len(v._known) == 10


def test_documents(spark):
    rows = [(1, "Hello world", 5), (2, None, None), (3, "", 1), (1, "Hello world", 5), (None, "a" * 10000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = token_counts.count_tokens(docs, REAL)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(i, t, LIBRARY(t) if t else 0) for i, t, _ in rows], key=repr)
    assert token_counts.count_tokens(docs.limit(0), REAL).count() == 0
