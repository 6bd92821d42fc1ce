"""Merkle audit against direct comparison."""

import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from argil.llm import fixity


def frame(spark, rows):
    """Records ``(archive, id, place, length, digest)`` laid out in the order of places."""
    return fixity.lay_out(spark.createDataFrame(rows, "archive long, record_id string, place long, length long, digest string"), ["place"], block=5).drop("place")


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>é</p>" * (i % 90)) for i in range(700)] + [(None, None, None), (5, "u", None), (5, "u", None), (9, "", "")] + [(None, "same", "x" * 50)] * 200 + [(1000 + i, "u", "y") for i in range(2500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("archive", F.lit("x"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = fixity.query(spark, str(tmp_path)).collect()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, c.sql(fixity.ORACLE).fetchall()))


def test_every_fault_is_located(spark):
    rows = [(a, f"r{a}.{k}", k, 1000 + k % 7, f"d{a}.{k}") for a in range(3) for k in range(400)]
    left = frame(spark, rows)
    assert fixity.compare(left, left).count() == 0
    other = {(r[0], r[2]): r for r in rows}
    starts = {(r.archive, r.record_id): r.offset for r in left.collect()}
    other[1, 5] = (1, "r1.5", 5, 1005, "rotten")
    other[2, 299] = (2, "r2.299", 299, 999, "longer")
    del other[0, 70], other[0, 71], other[2, 0]
    other[0, 400] = (0, "more", 400, 5, "more")
    other[0, 30.5] = (0, "between", 30, 5, "zz")
    other[7, 0] = (7, "new", 0, 5, "a new archive")
    right = frame(spark, list(other.values()))
    at = {(r.archive, r.record_id): r.offset for r in right.collect()}
    found = {(r.archive, r.record_id): (r.status, r.offset) for r in fixity.compare(left, right).collect()}
    lost = {k: ("missing", starts[k]) for k in ((0, "r0.70"), (0, "r0.71"), (2, "r2.0"))}
    changed = {k: ("changed", starts[k]) for k in ((1, "r1.5"), (2, "r2.299"))}
    assert found == lost | changed | {k: ("extra", at[k]) for k in ((0, "more"), (0, "between"), (7, "new"))}
    same, new = (fixity.root(fixity.tree(x)).collect() for x in (left, right))
    assert len(same) == 1 and same != new and same == fixity.root(fixity.tree(left.repartition(7))).collect()


def test_only_what_differs_is_read(spark):
    """After a lost record all others lie elsewhere, but hardly any range differs."""
    rows = [(0, f"r{k}", k, 1000, f"d{k}") for k in range(4000)]
    a, b = (fixity.tree(frame(spark, x)) for x in (rows, rows[:100] + rows[101:]))
    keys = fixity._KEYS[0]
    assert a[0].count() > 150 and fixity._differ(a[0], b[0], keys).count() <= 2


def test_copies(spark):
    """Copies of one record in thousands: ranges stay short, and those too few or too many are counted."""
    rows = [(0, "same", 5, 10, "d")] * 3000 + [(0, f"r{k}", 9, 10, f"e{k}") for k in range(50)] + [(0, None, 1, 3, None)] * 2
    left, right = frame(spark, rows), frame(spark, rows[2:] + [(0, "r7", 9, 10, "e7")])
    assert left.groupBy(*fixity._KEYS[0]).count().filter(f"count > {fixity.STRIDE}").count() == 0
    spans = sorted((r.offset, r.length) for r in left.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    found = fixity.compare(left, right).collect()
    assert sorted((r.record_id, r.status) for r in found) == [("r7", "extra"), ("same", "missing"), ("same", "missing")]


def test_no_records(spark):
    none = frame(spark, [])
    some = frame(spark, [(0, "a", 0, 10, None), (0, "b", 1, 5, "x")])
    assert fixity.compare(none, none).count() == 0
    assert {r.status for r in fixity.compare(some, none).collect()} == {"missing"}
    assert fixity.root(fixity.tree(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    left, right = fixity.replicas(pages)
    assert left.count() == right.count() == 0


def warc(parts, packed):
    records = [b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\ncontent-length: %d\r\n\r\n%b\r\n\r\n" % (i, len(p), p) for i, p in enumerate(parts)]
    return [gzip.compress(r, mtime=0) if packed else r for r in records]


def test_split():
    r = random.Random(0)
    parts = [r.randbytes(r.randint(0, 100_000)) for _ in range(30)]
    for packed in (False, True):
        records = warc(parts, packed)
        data = b"".join(records)
        spans = fixity.split(data)
        assert [data[a : a + n] for a, n, _ in spans] == records and [i for _, _, i in spans] == [f"<urn:{k}>" for k in range(30)]
        for cut in (0, 1, 50, len(data) // 2, len(data) - 1):
            spans = fixity.split(data[:cut])
            assert sum(n for _, n, _ in spans) == cut and all(a == b + m for (a, _, _), (b, m, _) in zip(spans[1:], spans))


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files(spark, packed):
    """A record lost, one added, one with a wrong byte, and a file lost: each is one row, or one for each of the file's records."""
    r = random.Random(1)
    parts = [r.randbytes(r.randint(100, 900)) for _ in range(100)]
    records = warc(parts, packed)
    start = [sum(map(len, records[:k])) for k in range(101)]
    spoiled = bytearray(records[40])
    spoiled[-20 if not packed else 12] ^= 1
    (new,) = warc([b"a new one"], packed)
    new = new.replace(b"<urn:0>", b"<urn:x>") if not packed else gzip.compress(gzip.decompress(new).replace(b"<urn:0>", b"<urn:x>"), mtime=0)

    def audit(*changed):
        files = [[(f"{n}.warc", bytearray(x)) for n, x in zip("abc", own)] for own in ((b"".join(records),) * 3, changed)]
        tables = [fixity.archive_records(spark.createDataFrame([*f, ("null.warc", None)], "path string, content binary")) for f in files]
        return sorted((x.archive, x.offset, x.status) for x in fixity.compare(*tables).collect())

    whole = b"".join(records)
    assert audit(whole, whole, whole) == []
    lost = b"".join(records[:10] + records[11:])
    assert audit(whole, lost, whole) == [("b.warc", start[10], "missing")]
    assert audit(b"".join(records[:70] + [new] + records[70:]), lost, whole) == [("a.warc", start[70], "extra"), ("b.warc", start[10], "missing")]
    if not packed:
        assert audit(whole, whole, b"".join(records[:40] + [bytes(spoiled)] + records[41:])) == [("c.warc", start[40], "changed")]
    assert [x[::2] for x in audit(whole, whole)] == [("c.warc", "missing")] * 100
