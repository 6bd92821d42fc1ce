"""Queries on customers beyond those of the small tables, and what they ask of memory."""

import json
import random
import struct

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argil.functions import decode, dims
from argil.functions import expressions as X
from argil.operators import findings, metadata, pii
from argil.plans import catalogue, containers, inputs
from argil.sources import files

from tests.test_queries import rows

#: Keys whose noisy pickle has a brace as its ninth byte.
BRACES = (16421, 17597, 28930)


def header(n):
    """A safetensors file whose header has a length of ``n``."""
    own = json.dumps({"__metadata__": {"a": ""}}).encode()
    return struct.pack("<Q", n) + own[:-3] + b"x" * (n - len(own)) + own[-3:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A driver folder with customers of which some have such pickles."""
    out = str(tmp_path_factory.mktemp("customers"))
    spark.createDataFrame([(k, f"C{k}", 1, 0.0, "BUILDING") for k in (*range(16415, 16430), *BRACES[1:])], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{out}/customer.parquet")
    return out


def test_detect_pickle_with_a_brace(spark):
    pickles = [containers.content(k, "") for k in BRACES]
    assert {p[8:9] for p in pickles} == {b"{"}
    cases = [(p, "pytorch-legacy-pickle") for p in pickles]
    cases += [(b"(" + bytes(6) + b"\1{", "pytorch-legacy-pickle"), (b"\x80\x04" + bytes(2) + b"\1" + bytes(3) + b"{", "pytorch-legacy-pickle"), (struct.pack("<Q", 0x05F5E180) + b"{", "pytorch-legacy-pickle")]
    cases += [(header(n), "safetensors") for n in (0x80, 0x63, 0x7D, 0x15D, 0x628)] + [(struct.pack("<Q", 0x05F5E080) + b"{", "safetensors"), (b"\1" + bytes(6) + b"\1{", "safetensors")]
    assert [decode.detect("x", data) for data, _ in cases] == [kind for _, kind in cases]
    found = spark.createDataFrame([(i, bytearray(data[:64])) for i, (data, _) in enumerate(cases)], "i int, content binary").select("i", X.detect_format(F.lit("x"), F.col("content")).alias("f"))
    assert [r.f for r in found.sort("i").collect()] == [kind for _, kind in cases]
    assert decode.read_safetensors(header(0x80)).metadata[0][0] == "a"


@pytest.mark.parametrize("name", ["pickle_disasm", "zip_streams", "artifact_scan", "entropy_findings", "artifact_reports", "rule_pack_files"])
def test_queries_on_such_pickles(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
        wanted = c.sql(catalogue.ORACLE_SQL[name])
        assert rows(df.columns, df.collect()) == rows(wanted.columns, wanted.fetchall())


def test_small_batches_of_decoded_rows():
    """Files come out a few hundred a batch, of about a megabyte, whatever the batches that go in; one bad file is one error."""
    n = 3000
    paths = [f"c/{k}.{containers.EXTENSIONS[k % 7]}" for k in range(n)]
    taken, given = [], []

    def batches():
        for at in range(0, n, 1000):
            taken.append(len(given))
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + 1000)), pa.array(["BUILDING"] * 1000)], names=["k", "s"])

    for batch in files.decoding(raw=True)(containers._made(batches())):
        given.append(batch)
    assert taken[-1] > 0  # made as they are asked for
    assert max(b.num_rows for b in given) <= files.ROWS and max(b.nbytes for b in given) <= 2 * files.BYTES and len(given) < n / 100
    assert [p for b in given for p, head in zip(b.column("path").to_pylist(), b.column("head").to_pylist()) if head] == paths
    long = json.dumps({"__metadata__": {"a": "x" * (3 << 20)}}).encode()
    bad = json.dumps({"__metadata__": {"a": "\ud800"}}).encode()
    contents = [struct.pack("<Q", len(h)) + h for h in (long, bad, long)] + [containers.content(3, "")] * 600
    out = list(files.decoding(raw=False)([pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(len(contents))]), pa.array(contents, pa.binary())], names=["path", "content"])]))
    assert [b.num_rows for b in out] == [1, 1, 1, 256, 256, 88] and [r for b in out for r in b.column("path").to_pylist()] == [f"f{i}" for i in range(len(contents))]
    assert [b.column("error")[0].is_valid for b in out] == [False, True, False, False, False, False]


def test_files_are_made_and_decoded_in_one_worker(spark, folder):
    """One Python step for each query on files, so half the workers, and no file goes through the JVM."""
    for name in ("pickle_findings", "entropy_findings", "safetensors_kv", "artifact_scan", "zip_streams", "pickle_disasm"):
        leaves = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in leaves and "MapInArrow" in leaves


def test_customers_are_dealt_out(spark, tmp_path):
    """A table of one file is one row group, so one task; its pairs are made by all cores."""
    spark.range(40).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    kv = inputs.customer_kv(spark, str(tmp_path))
    assert kv.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in kv.rdd.glom().map(len).collect()) > 1 and kv.count() == 320


def test_sorting_runs_the_scanners_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    made = spark.range(1000).selectExpr("concat('p', id % 7) AS path", "id AS seq", "CAST(id % 5 AS TINYINT) AS sev_ord", "0.5D AS confidence")
    out = findings.ordered(made.mapInArrow(run, made.schema)).collect()
    assert ran.value == 1000
    assert out == sorted(out, key=lambda r: (r.path, -r.sev_ord, -r.confidence, r.seq))


def test_values_that_are_passed_over_hold_no_match(spark):
    """Searches behind byte searches find what the patterns alone do, capitals, letters and digits of other alphabets included."""
    r = random.Random(7)
    parts = ["10.1.2.3", "10.\u0661.2.3", "AzureML", "\u017fageMaker", "sagema\u212aer", ".\u0130nternal", ".\u0131nternal", ".INTERNAL", "ec2-1", "EC2-\u0663", "g\u017f://", "S3://b", " ", "x", "\u00e9", "\u00df", "-"]
    parts += ["\u0661" * 4, "\u0967" * 12, "123-45-6789", "1234 5678 9012", "ABCDE1234F", "ABCDE\u0661\u0661\u0661\u0661F", "DE89370400440532013000", "192.168.0.1", "4111 1111 1111 1111", "/home/u", "/Users/v", "/root/w", "/var/x", "C:\\Users\\y", "z:\\users\\q"]
    texts = [None, "", *parts, *("".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(3000))]
    table = spark.createDataFrame([(t,) for t in texts], "v string").repartition(4)
    v = F.col("v")

    def plain(pattern):
        out = F.regexp_extract(v, "(?U)" + pattern, 0)
        return F.when(out != "", out)

    pairs = [(metadata.infrastructure(v), plain(metadata.CLOUD.pattern)), (metadata.build_path(v), F.coalesce(plain(dims.UNIX_PATH), plain(dims.WINDOWS_PATH)))]
    for rule in dims.PII_RULES:
        all_ = F.slice(F.regexp_extract_all(v, F.lit("(?U)" + rule.pattern), F.lit(0)), 1, rule.most)
        if rule.rule_id == dims.LUHN_RULE:
            all_ = F.filter(all_, lambda h: X.luhn_ok(h))
        if rule.digits:
            pairs.append((F.coalesce(F.transform(pii.hits(v, (rule,)), lambda h: h.hit), F.array().cast("array<string>")), F.coalesce(all_, F.array().cast("array<string>"))))
    checks = [F.count_if(~a.eqNullSafe(b)).alias(f"differ{i}") for i, (a, b) in enumerate(pairs)] + [F.count_if(F.size(b) > 0 if i > 1 else b.isNotNull()).alias(f"found{i}") for i, (_, b) in enumerate(pairs)]
    row = table.agg(*checks).first().asDict()
    assert not any(n for k, n in row.items() if k.startswith("differ")), row
    assert all(n for k, n in row.items() if k.startswith("found")), row
