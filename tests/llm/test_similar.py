"""Near copies of the pipeline's stage against brute-force similarity."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from argil.llm import simhash_dedup
from argil.llm._text import raw
from tests.llm.test_kernels import WORD

SCHEMA = "doc_id long, text string"


def bag(text, size=5):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else Counter()


def slow_groups(rows):
    bags = [(i, bag(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(bags, 2):
        both = (x & y).total()
        if 5 * both >= 4 * (x.total() + y.total() - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    make = lambda n: ["w%d" % r.randrange(500) for _ in range(n)]
    line = make(40)
    out = [(i, " ".join(make(r.randint(1, 60)) + line)) for i in range(60)]
    for i in range(100, 400, 5):
        base = make(r.randint(6, 200))
        out.append((i, " ".join(base)))
        for k in range(1, 5):
            near = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 30))):
                near[r.randrange(len(near))] = "other"
            out.append((i + k, "  ".join(near).upper()))
    exact = make(49)  # 45 shingles of which 40, four fifths of the union, are shared; with one more word they aren't
    out += [(500, " ".join(exact[:44])), (501, " ".join(exact[:44] + make(10))), (502, " ".join(exact[:44] + make(11)))]
    twice = " ".join(make(70))
    out += [(600, twice), (601, f"{twice} {twice}"), (602, None), (603, ""), (604, "a b"), (605, "A  b"), (606, "a b c"), (607, "x " * 3000), (608, "x " * 3500)]
    return out + [(None, twice), (600, "another text of this id"), (609, "Another text of this id"), (607, "x " * 3000)]


@pytest.mark.parametrize("common, picked", [(0, 0), (1 << 16, 1 << 20)])
def test_all_near_copies(spark, rows, monkeypatch, common, picked):
    monkeypatch.setattr(simhash_dedup, "COMMON", common)
    monkeypatch.setattr(simhash_dedup, "PICKED", picked)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = simhash_dedup.near_duplicates(docs, shingle=5, similarity=0.8).collect()
    expected = slow_groups(rows)
    assert len(found) == len(rows) and expected[501] == 500 and expected[502] == 502 and expected[601] == 601
    assert all(r.component_id == expected.get(r.doc_id) for r in found)


def test_stage_keeps_one_of_all_near_copies(spark, rows):
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(slow_groups(rows).values()))
    assert sum(r.doc_id is None for r in kept) == 1


def slow_mark(text):
    hashes, _ = simhash_dedup.bags(*raw(pa.array([text or ""])), 5)
    hashes = hashes.tolist()
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fuzzy_keys_find_the_nearest(spark, rows, monkeypatch):
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash_dedup, "similar", lambda *_: none)
    r = random.Random(4)
    more = list(rows)
    for i in range(1000, 1040, 2):
        words = ["v%d" % r.randrange(900) for _ in range(600)]
        more += [(i, " ".join(words)), (i + 1, " ".join([*words, "end"]))]
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(spark.createDataFrame(more, SCHEMA), shingle=5, similarity=0.8).collect() if r.doc_id is not None}
    whole = slow_groups(more)
    assert all(whole[i] == whole[root] for i, root in found.items())
    marks = [(i, slow_mark(t), bag(t)) for i, t in more if i is not None]
    alone = {m for m, n in Counter(m for _, m, _ in marks).items() if n == 1}
    near = [(i, j) for (i, m, x), (j, o, y) in itertools.combinations(marks, 2) if {m, o} <= alone and (m ^ o).bit_count() <= 2 and 9 * (x & y).total() >= 4 * (x.total() + y.total())]
    assert len(near) > 10 and all(found[i] == found[j] for i, j in near)
    assert found[607] == found[608] == 607  # one fingerprint, two bags
    assert found[600] != found[601] or whole[601] == whole[600]  # one fingerprint or nearly, but too few shingles in common


def test_known_groups_are_not_compared_again(spark, rows):
    docs = spark.createDataFrame([x for x in rows if x[0] is not None], SCHEMA)
    classes = simhash_dedup._bag_digests(docs, 5).groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "id")
    find = lambda groups: {(r.a, r.b) for r in simhash_dedup.similar(docs, classes, 5, 0.8, len(rows), groups).collect()}
    nothing = spark.createDataFrame([], "node long, root long")
    every = find(nothing)
    a, b = min(every)
    known = spark.createDataFrame([(a, a), (b, a)], "node long, root long")
    assert every - find(known) == {(a, b)}
    assert not find(classes.selectExpr("fp AS node", "1L AS root"))
