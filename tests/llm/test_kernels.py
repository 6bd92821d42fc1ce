"""Vectorised kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from argil.llm import golay, simhash_dedup
from argil.llm._stats import features
from argil.llm._text import covered, hash_spans, hash_windows, raw, slices, window_starts, words, xxh64_spans
from argil.llm.compression_rules import counts

WORD = re.compile("[^\x20\x09-\x0d]+")
ALPHABET = st.sampled_from(list("aAbB #|é日\n\t .\x0b\x85"))
TEXTS = st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=60), st.text(max_size=20)), max_size=8)


def column(texts):
    return pa.array(texts, pa.string())


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = raw(column(texts))
    starts, ends, first = words(data, offsets)
    view = data.tobytes()
    for i, t in enumerate(texts):
        assert [view[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] == WORD.findall(t or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=20))
def test_hashes(spans):
    data = np.frombuffer(b"".join(spans) + bytes(8), dtype=np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    assert xxh64_spans(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]
    own = hash_spans(data, starts, ends)
    assert len(set(own.tolist())) == len(set(spans))


def test_windows():
    h = np.array([1, 2, 3, 1, 2, 3, 9], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = hash_windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4
    places, row = window_starts(np.array([0, 2, 2, 7]), 3)
    assert places.tolist() == [2, 3, 4] and row.tolist() == [2, 2, 2]
    assert covered(6, np.array([1, 2]), 2).tolist() == [False, True, True, True, False, False]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([column(["x" * n for n in (0, 5, 100, 1, 1, 200, 0)] + [None])], names=["text"])
    parts = list(slices(batch, "text", 100))
    assert sum(map(len, parts)) == 8 and max(map(len, parts)) > 1


def slow_counts(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.sampled_from("ab"), max_size=40))
def test_counts(texts, few):
    texts = [*texts, " ".join(few), "\n".join(few)]
    data, offsets = raw(column(texts))
    found = counts(data, offsets)
    assert np.stack(list(found.values()), axis=1).tolist() == [slow_counts(t) for t in texts]
    assert np.isfinite(features(data, offsets)).all()


def slow_simhash(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_simhash(texts):
    assert simhash_dedup.simhash(*raw(column(texts))).tolist() == [slow_simhash(t) for t in texts]


def test_golay_is_perfect():
    every = np.arange(1 << golay.LENGTH, dtype=np.uint32)
    sizes = np.bincount(golay.decode(every), minlength=1 << golay.MESSAGE)
    assert sizes.min() == sizes.max() == 2048


def test_keys_find_all_within_two_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    asked, found = simhash_dedup.keys(a), simhash_dedup.keys(b)
    left = {(r, k) for r, k, asks in zip(*asked) if asks}
    right = {(r, k) for r, k, asks in zip(*found) if not asks}
    assert {r for r, _ in left & right} == set(range(len(a)))
