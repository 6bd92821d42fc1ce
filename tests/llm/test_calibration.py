"""Toxicity thresholds come from all labelled rows, at their classes' true shares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argil.llm import toxicity
from argil.llm._labels import labelled


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    docs = []
    for i in range(3000):
        toxic = i % 10 == 0
        w = ["w%d" % r.randrange(400) for _ in range(12)]
        # what tells the classes apart is also in many clean documents
        if toxic or r.random() < 0.2:
            w[3:3] = ["vileword"] * (2 if toxic and r.random() < 0.7 else 1)
        docs.append((i, " ".join(w), r.choice(["en", "de", None]), int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int").cache()
    return docs.drop("toxic"), docs.select("doc_id", "toxic")


def test_thresholds_are_those_of_all_unseen_rows(spark, corpus, monkeypatch):
    docs, labels = corpus
    seen = {}
    real = toxicity.unseen

    def spy(rows, labels, label, model, trained):
        seen["trained"], seen["found"] = set(trained.tolist()), real(rows, labels, label, model, trained)
        return seen["found"]

    monkeypatch.setattr(toxicity, "unseen", spy)
    model, by_lang = toxicity.fit(docs, labels, most=60)
    truth = {r.doc_id: r.label for r in labelled(labels, "toxic").collect()}
    scores, classes, langs, n = seen["found"]
    assert len(seen["trained"]) == 96 and n.sum() == len(truth) - 96
    y = np.array(list(truth.values()))
    trained = np.array([truth[i] for i in seen["trained"]])
    assert np.bincount(classes, n, 2).tolist() == (np.bincount(y) - np.bincount(trained)).tolist()
    # 0.5 is, within a bin, where F1 over all rows is best
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id in truth and r.doc_id not in seen["trained"]]
    s, t = np.array([r.score for r in rows]), np.array([truth[r.doc_id] for r in rows])
    w = np.where(t == 1, y.sum() / t.sum(), (1 - y).sum() / (1 - t).sum())
    f1 = lambda at: 2 * (w * t * (s >= at)).sum() / ((w * (s >= at)).sum() + (w * t).sum())
    assert f1(0.5) > max(f1(x) for x in np.linspace(0.001, 0.999, 999)) - 0.02


def test_shares_count():
    scores, y = np.array([0.9, 0.6, 0.6, 0.2]), np.array([1, 1, 0, 0])
    at = lambda clean: toxicity.calibrate(scores, y, [None] * 4, np.array([[50, 50], [50, 50], [20, clean], [80, 80]], dtype=float))[""]
    assert at(20) == pytest.approx(0.4) and at(400) == pytest.approx(0.75)


def test_four_thousand_rows_a_class_are_learnt_from(spark, monkeypatch):
    docs = spark.range(11000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(np.bincount(y)) or toxicity._initial(texts, y, np.random.default_rng(0)))
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert seen[0].sum() == 6400


def test_thresholds_by_brute_force():
    """The common threshold tries every cut; a language's moves from it to its own as its rows grow."""
    r = np.random.default_rng(3)
    scores, y = np.round(r.random(300), 2), (r.random(300) < 0.4).astype(int)
    scores = np.clip(scores + 0.3 * y, 0.01, 0.99)
    langs = ["en" if x else "de" for x in r.random(300) < 0.7]
    count = np.stack([np.ones(300), r.integers(1, 5, 300)], axis=1).astype(float)

    def f1(at, own):
        hit = own & (scores >= at)
        return 2 * count[hit & (y == 1), 1].sum() / (count[hit, 1].sum() + count[own & (y == 1), 1].sum())

    found = toxicity.calibrate(scores, y, langs, count)
    every = np.ones(300, dtype=bool)
    assert f1(found[""], every) == pytest.approx(max(f1(x, every) for x in np.linspace(0, 1, 1001)))
    logit = lambda p: np.log(p / (1 - p))
    for name in ("en", "de"):
        own = np.array([x == name for x in langs])
        best = toxicity.best_threshold(scores[own], y[own], count[own, 1])
        assert f1(best, own) == pytest.approx(max(f1(x, own) for x in np.linspace(0, 1, 1001)))
        n = own.sum()
        assert logit(found[name]) == pytest.approx((n * logit(best) + 50 * logit(found[""])) / (n + 50))
    assert set(toxicity.calibrate(scores, y, [None] * 300, count)) == {""}
    assert toxicity.calibrate(scores, y * 0, langs, count) == {}
