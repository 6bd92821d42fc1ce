"""Mixing against its SQL twin and against a plain water-filling."""

import random

import duckdb
import pytest

from argil.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string"


def compare(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "documents.parquet")
    docs.write.mode("overwrite").parquet(path)
    found = sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        assert found == sorted(c.sql(mixing.ORACLE).fetchall(), key=repr)
    return found


def filled(sizes):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_sources(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 30))), r.choice(["b", "a", "a", "a", "Z", "é", None]), "x") for i in range(400)]
    rows += [(400, None, "a", None), (401, "", "empty", "x"), (None, "one two", "b", "x"), (7, "again and again", "a", "x"), (7, "again and again", "a", "x")]
    found = compare(spark, rows, tmp_path)
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted, taken = filled(sizes), {}
    for r_ in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r_.taken in (0, r_.size, 2 * r_.size)
        assert r_.target == pytest.approx(wanted[r_.source], rel=1e-9)
        taken[r_.source] = taken.get(r_.source, 0) + r_.taken
    for s, t in taken.items():
        assert abs(t - wanted[s]) <= 40
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_take_keeps_columns(spark):
    rows = [(i, "a b c", f"s{i % 3}", "mine") for i in range(60)] + [(None, "x y", "s0", "mine")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.take(docs)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    found = out.collect()
    assert all(r.taken and r.text == ("x y" if r.doc_id is None else "a b c") for r in found)


def test_take_is_one_to_one(spark):
    rows = [(7, "a b", "s", "x"), (7, "c d", "s", "y"), (8, "e f", "s", "z")] + [(None, "same text", "t", str(i % 7)) for i in range(40)] + [(9, "same again", None, "w")] * 5 + [(1, None, "s", "n")] * 4
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("taken", "mine")
    out = sorted(map(tuple, mixing.take(docs.repartition(3), block=8).collect()), key=repr)
    left = [r[:4] for r in map(tuple, docs.collect())]
    for r in out:
        left.remove(r[:4])  # each row once at most
        assert r[-1] in (r[4], 2 * r[4])
    assert sum(r[-1] for r in out) == sum(r.taken for r in mixing.mix(docs).collect()) > 60
    assert out == sorted(map(tuple, mixing.take(docs.repartition(5)).collect()), key=repr)


def test_copies_unfold_in_blocks(spark, tmp_path):
    rows = [(None, "one two", "a", None)] * 50 + [(None, None, "b", None)] * 30 + [(i, f"w{i}", "b", None) for i in range(20)]
    whole = compare(spark, rows, tmp_path)
    docs = spark.createDataFrame(rows, SCHEMA)
    split = mixing.mix(docs, block=7).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, split), key=repr) == whole


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "one", "a", None)], [(1, "", "a", None), (2, " ", "b", None)]])
def test_few_rows(spark, tmp_path, rows):
    assert len(compare(spark, rows, tmp_path)) == len(rows)
