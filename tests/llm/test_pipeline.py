"""The pipeline: stages feed each other and their decisions take effect."""

from collections import Counter

import pytest

import corpus_pipeline
from argil.llm import decontamination, toxicity
from tests.llm.test_dedup import slow_removed
from tests.llm.test_kernels import WORD

SF = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert set(stages[0].columns) <= set(stages[-1].columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_toxicity_rejects(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, by_lang = toxicity.fit(stages[0], labels)
    scored = toxicity.score(stages[0], model, score_column="s").select("doc_id", "lang", "s").collect()
    bad = {r.doc_id for r in scored if r.s >= by_lang.get(r.lang or "", by_lang.get("", 0.5))}
    assert bad and set(ids(stages[1])) == set(ids(stages[0])) - bad


def test_one_of_each_group(stages):
    docs = [(r.doc_id, WORD.findall(r.text or "")) for r in stages[1].collect()]
    bags = [(i, Counter(tuple(x.translate(LOWER) for x in w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(x.translate(LOWER) for x in w)] * bool(w))) for i, w in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted(((sum(b.values()), i, b) for i, b in bags), key=lambda x: x[:2])
    for k, (n, i, a) in enumerate(by_size):
        for m, j, b in by_size[k + 1 :]:
            if n < 0.8 * m:
                break
            both = sum((a & b).values())
            if 5 * both >= 4 * (n + m - both):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    assert sorted(ids(stages[2])) == sorted({find(i) for i in root})


def test_passages_go(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    removed = {i: (n, gone) for i, n, gone, _ in slow_removed(sorted(before.items()))}
    after = {r.doc_id: r for r in stages[3].collect()}
    for i, (n, gone) in removed.items():
        assert (i in after) == (gone < n or not gone)
        if i in after:
            assert len(WORD.findall(after[i].text)) == n - gone
            assert after[i].n_chars == len(after[i].text)


def test_benchmark_goes(spark, stages):
    bad = set(ids(decontamination.matches(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet"))))
    assert bad and set(ids(stages[4])) == set(ids(stages[3])) - bad


def test_mix(stages):
    last = stages[5].collect()
    assert all(r.taken in (r.size, 2 * r.size) and r.taken and len(WORD.findall(r.text)) == r.size for r in last)
    total = sum(len(WORD.findall(r.text)) for r in stages[4].collect())
    assert 1.2 * total < sum(r.taken for r in last) <= 1.5 * total


def test_run_equals_stages(spark, stages):
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, stages[5].collect()))


def test_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", None, 10), (None, None, None, None, None), (3, "x " * 40000, "de", "a", 80000)]
    docs = spark.createDataFrame(rows, stages_schema(spark))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    assert {r.doc_id for r in docs.collect()} <= {None, 3}
    empty = spark.createDataFrame([], stages_schema(spark))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def stages_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema
