"""Decontamination against every window of every document."""

import random

import pyarrow as pa

from argil.llm import decontamination
from tests.llm.test_kernels import WORD


def bag(words):
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]


def jaccard(a, b):
    keys = {*a, *b}
    return sum(min(a.count(k), b.count(k)) for k in keys) / sum(max(a.count(k), b.count(k)) for k in keys)


def lower(t):
    return [w.lower() for w in WORD.findall(t or "")]


def slow(docs, items):
    out = {}
    for d, t in docs:
        w = lower(t)
        for i, u in items:
            v = lower(u)
            if not v or i is None or (len(v) < 5 and len(w) < len(v)) or (len(v) >= 5 and len(w) < 5):
                continue
            for k in range(max(1, len(w) - len(v) + 1)):
                s = jaccard(bag(w[k : k + len(v)]), bag(v))
                if s >= 0.8 and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = s, k
    return out


def test_pairs(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(make(r.randint(12, 50)))) for i in range(25)] + [(90, "two words"), (91, ""), (92, None), (None, "a b c d e f"), (93, "r r r r r r r r r s s s s s s"), (0, None)]
    docs = []
    for d in range(120):
        body = make(r.randint(0, 60))
        _, t = items[r.randrange(25)]
        part = t.split()
        if d % 3 == 0 and len(part) > 3:
            part[r.randrange(len(part))] = "changed"
        if d % 3 == 1:
            part = [p.upper() for p in part]
        if d % 5:
            body[len(body) // 2 : len(body) // 2] = part if d % 7 else part[2:]
        docs.append((d, "\n".join(body) if d % 2 else "  ".join(body)))
    docs += [(500, None), (501, ""), (502, "Two WORDS"), (503, "r r r r r r r r r s s s s s s"), (503, "nothing here")]
    frame = spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs], "doc_id long, text string, item_id string, similarity double")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert len(want) > 50
    found = decontamination.matches(frame, benchmark).collect()
    assert {(x.doc_id, x.item_id): (x.similarity, x.start) for x in found} == want
    clean = decontamination.without_benchmark(frame, benchmark)
    assert clean.columns == frame.columns
    bad = {d for d, _ in want}
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, t in docs if d not in bad or t == "nothing here")


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST", 7000)
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x a{i} b{i} c{i} d{i} e{i} f{i} y") for i in range(10)] + [(10, "z")], "doc_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontamination.matches(docs, items).collect()) == [(i, i) for i in range(10)]
    assert [x.doc_id for x in decontamination.without_benchmark(docs, items).collect()] == [10]
    assert decontamination.matches(docs, items.limit(0)).count() == 0
    assert decontamination.without_benchmark(docs, items.limit(0)).count() == 11
    assert decontamination.matches(docs.limit(0), items).count() == 0


def test_crowded_windows():
    import numpy as np

    r = random.Random(1)
    for _ in range(500):
        n, wanted = r.randint(1, 60), r.randint(1, 20)
        least = r.randint(1, wanted)
        places = np.array(sorted(r.sample(range(n), r.randint(0, n))), dtype=np.int64)
        known = set(places.tolist())
        want = [w for w in range(n) if sum(p in known for p in range(w, w + wanted)) >= least]
        assert decontamination.crowded(places, wanted, least).tolist() == want


def near_pairs(n, seed=7):
    """Items, and texts whose similarity with theirs is 0.8 to 0.85, by chance of what is changed."""
    r = random.Random(seed)
    while n:
        v = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 45, 60, 90, 150, 300, 800]))]
        w = list(v)
        for _ in range(max(1, round(len(v) * r.uniform(0.015, 0.025)))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w[k:k] = ["y"] * r.randint(1, 3)
            w = w[: len(v)]
        if 0.8 <= decontamination.similarity(*(decontamination.hash_windows(decontamination._word_hashes(pa.array([" ".join(x)]))[0], 5) for x in (v, w))) <= 0.85:
            n -= 1
            yield " ".join(v), " ".join(w)


def test_recall_near_the_threshold():
    pairs = list(near_pairs(3000))
    found = 0
    for at in range(0, len(pairs), 100):
        block = pairs[at : at + 100]
        index = decontamination.build([(i, v) for i, (v, _) in enumerate(block)])
        got = decontamination.find(index, pa.array([w for _, w in block]))
        found += sum((i, i) in got for i in range(len(block)))
    print("recall", found / len(pairs))
    assert found >= 0.998 * len(pairs)


def test_a_long_item_takes_bounded_memory():
    import tracemalloc

    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    index = decontamination.build([(1, " ".join(words))])
    text = pa.array([" ".join(words[:10] + words + words[-50:])])
    tracemalloc.start()
    found = decontamination.find(index, text)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and found[0, 1] == (1.0, 10)


def test_index_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    shingles = rng.integers(0, 2**63, (200, 30), dtype=np.uint64)
    own = decontamination.Length(34, list(range(200)), shingles)
    asked = own.fps ^ rng.integers(0, 2**64, 200, dtype=np.uint64) & rng.integers(0, 2**64, 200, dtype=np.uint64) & rng.integers(0, 2**64, 200, dtype=np.uint64)
    found = set(zip(*(x.tolist() for x in own.candidates(asked))))
    assert found == {(i, j) for i in range(200) for j in range(200) if (int(asked[i]) ^ int(own.fps[j])).bit_count() <= decontamination.RADIUS}
