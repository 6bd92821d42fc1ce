"""Near duplicates and repeated passages against brute force, with awkward rows."""

import hashlib
import itertools
import random
import re

import pytest

from argil.llm import components, simhash_dedup, substring_dedup
from tests.llm.test_kernels import WORD, slow_simhash

SCHEMA = "doc_id long, text string, n_words string, kept int, component_id string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7, None) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = make(70), make(900)
    out = [(i, make(r.randint(1, 120))) for i in range(60)]
    out += [(100 + i, f"{make(9)} {passage}\n{make(12)}") for i in range(6)]
    edited = base.split()
    for i in range(8):
        edited = list(edited)
        edited[r.randrange(len(edited))] = "other%d" % i
        out.append((200 + i, " ".join(edited)))
    out += [(300, ""), (301, None), (302, " \n"), (303, "one"), (304, "ONE"), (305, passage), (306, passage + " " + passage)]
    out += [(307, base), (307, base), (308, None), (None, base), (None, passage), (None, None), (309, "ä" * 5000 + " b")]
    return out


def test_near_duplicates(spark, texts):
    found = simhash_dedup.near_duplicates(rows(spark, texts)).collect()
    assert len(found) == len(texts)
    fps = [(i, slow_simhash(t)) for i, t in texts]
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in found) == sorted((i or -1, f) for i, f in fps)
    named = [(i, f) for i, f in fps if i is not None]
    root = {i: i for i, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, f), (j, g) in itertools.combinations(named, 2):
        if (f ^ g).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    for r in found:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))


def test_keep_one(spark, texts):
    docs = rows(spark, texts)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values()))
    assert ids.count(None) == 3


def test_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5), (1001, 1000)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_removed(texts):
    first = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_passages(spark, texts, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", size)
    monkeypatch.setattr(substring_dedup, "GROUP_ROOT", 1)
    found = substring_dedup.remove_repeats(rows(spark, texts), digest=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == slow_removed(texts)


def test_passages_cut_from_texts(spark, texts):
    docs = rows(spark, texts)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert all(r.n_words == "x" and r.kept == 7 for r in found)
    left = {r.doc_id: r.text for r in found if r.doc_id is not None}
    assert 305 not in left and 306 not in left and left[300] == "" and left[301] is None
    assert len(re.findall("w", left[101])) == 21
    plain = spark.createDataFrame([(1, "a b", 3), (2, None, None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, substring_dedup.without_repeats(plain).collect())) == [(1, "a b", 3), (2, None, None)]


def test_no_rows(spark):
    none = rows(spark, [])
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.keep_one(none).count() == 0
    assert substring_dedup.remove_repeats(none, digest=True).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0
