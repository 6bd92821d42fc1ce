"""Classifiers: held-out accuracy, determinism, and awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from argil.llm import compression_rules, quality, toxicity
from argil.llm._labels import held_out, sample
from argil.llm._stats import _CHARS, features
from argil.llm._text import raw
from tests.llm.test_kernels import WORD, column, slow_counts

SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    plain = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    bad = {"en": ["vileword", "nasty"], "de": ["schlimmling", "schlimmes", "schlimmste"]}
    docs, labels = [], []
    for i in range(1600):
        lang = r.choice(["en", "de"])
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic, junk = i % 6 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad[lang]).upper() if i % 12 else r.choice(bad[lang]) + ".")
        text = " | ".join(w) if junk else ". ".join(w)
        docs.append((i, text, lang, "x"))
        if i % 5:
            labels.append((i, int(not junk), int(toxic)))
    docs += [(2000, None, None, None), (2001, "", "en", None), (2002, "x " * 50000, "xx", None), (None, "nasty vileword nasty", "en", None), (3, docs[3][1], docs[3][2], "x")]
    labels += [(None, 1, 1), (10, None, None), (1, 0, 0), (1, 1, 0), (99999, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def area(scores, y):
    rank = np.argsort(np.argsort(scores))
    n = y.sum()
    return (rank[y].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def apart(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_sample_never_has_held_out_rows(corpus):
    _, labels, _ = corpus
    chosen = sample(labels, "toxic", 50).collect()
    ids = [r.doc_id for r in chosen]
    assert len(ids) == 100 == len(set(ids)) and sum(r.label for r in chosen) == 50
    assert not any(apart(i) for i in ids) and None not in ids
    assert 1 not in [r.doc_id for r in sample(labels, "quality", 5000).collect()]


def test_toxicity(corpus):
    docs, labels, rows = corpus
    model, by_lang = toxicity.fit(docs, labels)
    assert set(by_lang) <= {"", "en", "de"} and "" in by_lang
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "score"]
    found = scored.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1600 and apart(r.doc_id)]
    s, y = np.array([r.score for r in held]), np.array([r.doc_id % 6 == 0 for r in held])
    assert area(s, y) > 0.98 and ((s >= 0.5) == y).mean() > 0.95
    again, _ = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == {r.doc_id: r.score for r in found}
    kept = toxicity.keep(docs, model, by_lang)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None not in ids and {2000, 2001, 2002} <= ids


def test_score_does_not_depend_on_neighbours(corpus):
    docs, labels, rows = corpus
    model, _ = toxicity.fit(docs, labels)
    texts = [t for _, t, _, _ in rows[:50]] + [None, "", "nasty", "x " * 3000]
    together = model.scores(*toxicity.tokens(*raw(column(texts))))
    alone = [model.scores(*toxicity.tokens(*raw(column([t]))))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_convolution_by_loops(corpus):
    """Each filter at each place by plain loops, its maximum over a document, and the logistic layer."""
    docs, labels, rows = corpus
    model, _ = toxicity.fit(docs, labels)
    for text in [rows[0][1], rows[6][1], "nasty", "one two"]:
        hashed, _ = toxicity.tokens(*raw(column([text])))
        x = [[float(model.embedding[k][b][d]) for k, b in enumerate(h) for d in range(toxicity.DIM)] for h in hashed]
        z = model.out_bias
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(x[at + j][i] * float(model.filters[w][j][i][f]) for j in range(w) if at + j < len(x) for i in range(len(x[0]))) for at in range(len(x))]
                z += max(0.0, max(values) + float(model.bias[k * toxicity.FILTERS + f])) * float(model.out[k * toxicity.FILTERS + f])
        assert abs(model.scores(hashed, np.array([0, len(hashed)]))[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_words_of_the_sample_are_bounded(corpus, monkeypatch):
    docs, labels, _ = corpus
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((texts, y)) or toxicity._initial(texts, y.astype(np.float32), np.random.default_rng(0)))
    toxicity.fit(docs, labels, words=2000)
    texts, y = seen[0]
    assert all(sum(len(t) for t, v in zip(texts, y) if v == k) <= 2000 for k in (0, 1)) and 0 < y.sum() < len(y)


def test_repeated_ids_and_clashing_names(spark, corpus):
    docs, labels, _ = corpus
    twice = docs.unionByName(docs.limit(0)).union(spark.createDataFrame([(7, "another text", "en", "x"), (8, "nasty vileword", "de", "x")], SCHEMA))
    models = [toxicity.fit(twice.repartition(n), labels)[0] for n in (2, 9)]
    assert np.array_equal(models[0].embedding, models[1].embedding)
    forests = [quality.fit(twice.repartition(n), labels) for n in (2, 9)]
    assert np.array_equal(forests[0].leaf, forests[1].leaf)
    own = docs.withColumn("__score", docs.doc_id)
    assert sorted(r["__score"] for r in toxicity.keep(own, models[0], {}).filter("doc_id < 9").collect()) == sorted(r.doc_id for r in toxicity.keep(docs, models[0], {}).filter("doc_id < 9").collect())
    for f, m in ((toxicity.score, models[0]), (quality.score, forests[0])):
        with pytest.raises(ValueError):
            f(docs, m, score_column="text")
    assert [r[0] for r in spark.createDataFrame([(None,)], "doc_id long").select(held_out("doc_id")).collect()] == [False]


def slow_features(text):
    """The statistics of one text, each from its definition."""
    b = text.encode()
    share = {k: sum(x in v for x in b) / max(len(b), 1) for k, v in _CHARS.items()}
    known = set().union(*map(set, _CHARS.values()))
    other, high = (sum(f(x) for x in b) / max(len(b), 1) for f in (lambda x: x < 0x80 and x not in known, lambda x: x >= 0x80))
    w = WORD.findall(text)
    n = max(len(w), 1)
    size = [len(x) for x in w]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    mean = sum(size) / n
    ends = [x.encode()[-1] for x in w]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    rest = [np.log1p(len(w)), mean, max(sum(x * x for x in size) / n - mean**2, 0) ** 0.5, max(size, default=0)]
    rest += [sum(x <= 3 for x in size) / n, sum(x >= 12 for x in size) / n, sum(x in b"#*$%&|<>" for x in ends) / n, sum(any(c in "#*$%&|<>" for c in x) for x in w) / n]
    rest += [sum(x in b".!?" for x in ends) / n, sum(x == y for x, y in zip(w, w[1:])) / n, 1 - (len(w) - len(set(w))) / n]
    rest += [np.log1p(len(lines)), len(w) / max(len(lines), 1), (len(lines) - len(set(lines))) / max(len(lines), 1), len(again) / n]
    return [*share.values(), other, high, *rest]


def test_statistics_by_definition(spark):
    r = random.Random(2)
    texts = ["", " \n", "one", "Ünï cödé. #tag |x| 日本語", "a b c d e f g h " * 3, "line\nline\n\nother line\n line"]
    texts += [" ".join(r.choice(["alpha", "be", "gamma,", "x!", "#", "longlonglongword", "é", "12", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += [d.text for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if d.text and len(d.text) < 4000][:40]
    for found, text in zip(features(*raw(column(texts))), texts):
        assert np.allclose(found, slow_features(text)), text[:80]


def test_no_labels(spark, corpus):
    docs, labels, rows = corpus
    for none in (labels.limit(0), labels.filter("toxic = 0 AND quality = 1")):
        model, by_lang = toxicity.fit(docs, none)
        assert by_lang == {} and toxicity.keep(docs, model, by_lang).count() == len(rows)
        assert quality.score(docs, quality.fit(docs, none)).count() == len(rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality(corpus):
    docs, labels, rows = corpus
    forest = quality.fit(docs, labels)
    found = quality.score(docs, forest).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1600 and apart(r.doc_id)]
    s, y = np.array([r.score for r in held]), np.array([r.doc_id % 4 != 0 for r in held])
    assert area(s, y) > 0.98
    again = quality.fit(docs.repartition(5), labels)
    assert {r.doc_id: r.score for r in quality.score(docs, again).collect()} == {r.doc_id: r.score for r in found}


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = quality.train(x, y, trees=20)
    for row, margin in zip(x[:50], f.margin(x[:50])):
        total = f.base
        for t in range(20):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + (2 if row[f.feature[t, node]] > f.cut[t, node] else 1)
            total += f.leaf[t, node - f.feature.shape[1]]
        assert abs(total - margin) < 1e-9
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_compression(spark):
    r = random.Random(9)
    prose = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 8))) for _ in range(3000))
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(300))
    cycle = " ".join(f"{w} {w}" for w in prose.split()[:12] for _ in range(40))
    rows = [(1, prose, 0), (2, noise, 0), (3, cycle, None), (4, None, 0), (5, "", 0), (6, "few words", 0), (7, " ".join(prose.split()[:25]), 0), (1, prose, 0), (None, prose[:9000] + noise, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = compression_rules.judge(docs)
    found = out.collect()
    assert [f for f in out.columns if f == "kept"] == ["kept"]
    for f in found:
        assert [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words] == slow_counts(f.text)
        assert f.base_failed == (f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words)
        assert not (f.kept and f.base_failed)
    kept = {f.doc_id: f.kept for f in found}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True, None: False}
    assert compression_rules.judge(docs.limit(0)).count() == 0


def slow_verdict(text):
    """Limits of the text's length, written out again, over the library's own compressor."""
    b = text.encode()
    ratio = lambda x: len(zstandard.compress(x, 3)) / len(x)
    limits = [(262144, 0.24, 0.55), (65536, 0.28, 0.56), (16384, 0.31, 0.58), (4096, 0.34, 0.62), (1024, 0.37, 0.70), (512, 0.41, 0.80), (256, 0.44, 0.90), (128, 0.45, 1.15)]
    low, high = next(((x, y) for n, x, y in limits if len(b) >= n), (0, float("inf")))
    size, least, most = (4096, 0.36, 0.64) if len(b) >= 4096 else (512, 0.40, 0.82)
    chunks, rest = [], b
    while len(rest) >= size:
        chunks.append(rest[:size])
        rest = rest[size:]
    if chunks and rest:
        chunks.append(b[-size:])
    return low <= ratio(b) <= high and 3 * sum(not least <= ratio(c) <= most for c in chunks) <= len(chunks)


def test_compression_by_brute_force(spark):
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if d.text]
    noise = lambda n: " ".join("".join(r.choice(letters) for _ in range(40)) for _ in range(n // 41))
    texts += [t[:k] + noise(m) for t in texts[:60] for k, m in ((300, 400), (2000, 1500), (4096, 3000), (9000, 9000))]
    texts += [(f"word{i} " * 30 + noise(200)) * (i + 1) for i in range(20)]
    found = compression_rules.judge(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert all(f.kept == (not f.base_failed and slow_verdict(f.text)) for f in found)
    kept = [f.kept for f in found if not f.base_failed]
    assert 0.1 < sum(kept) / len(kept) < 0.95


def test_a_tail_of_noise_is_seen(spark):
    prose = next(d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if d.text and len(d.text.encode()) > 6000)
    r = random.Random(1)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(9)) for _ in range(300))
    docs = spark.createDataFrame([(1, prose[:4096] + noise), (2, prose[:6000]), (3, prose[:900]), (4, prose[:512] + noise[:700])], "doc_id long, text string")
    assert {f.doc_id: f.kept for f in compression_rules.judge(docs).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_sample_is_not_copied():
    rows = [np.arange(5 * n, dtype=np.uint16).tobytes() for n in (3, 0, 1, 700)]
    column = pa.chunked_array([pa.array(rows, pa.binary()), pa.array([], pa.binary()), pa.array([b"", *rows], pa.binary()).slice(2), pa.array([b""], pa.large_binary()).cast(pa.binary())])
    views = toxicity._views(column)
    assert [v.tobytes() for v in views] == column.to_pylist() and all(v.shape[1:] == (toxicity.TABLES,) for v in views)
    data = np.frombuffer(column.chunk(0).buffers()[2], dtype=np.uint8)
    assert all(np.shares_memory(v, data) for v in views[:4] if v.size)
