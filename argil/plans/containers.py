"""A model file made of each customer, of seven kinds in turn, and what is to be found in it, said in SQL."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argil.functions import dims
from argil.functions.schema import DECODED
from argil.plans import oracle
from argil.plans.inputs import MODULES, NAMES
from argil.sources.files import decoding

EXTENSIONS = ("gguf", "safetensors", "bin", "pkl", "ckpt", "onnx", "pt")
#: SHA-256 digests that make up the noisy stream.
_DIGESTS = 256
#: Files made at once.
_A_BATCH = 256


def _string(text: str) -> bytes:
    return struct.pack("<Q", len(text.encode())) + text.encode()


def gguf(k: int, segment: str) -> bytes:
    pairs = (("general.author", struct.pack("<I", 8) + _string(f"user{k} <user{k}@example.com>")), ("count", struct.pack("<II", 4, k)), ("tags", struct.pack("<IIQ", 9, 8, 2) + _string(segment) + _string(f"t{k}")), ("general.name", struct.pack("<I", 8) + _string(segment)))
    return b"GGUF" + struct.pack("<IQQ", 3, k % 50, len(pairs)) + b"".join(_string(key) + value for key, value in pairs)


def safetensors(k: int) -> bytes:
    tensors = "".join(f',"w{i}":{{}}' for i in range(k % 3 + 1))
    header = f'{{"__metadata__":{{"trained_by":"/home/u{k}/run","format":"pt","n":3,"aws":"AKIA{k:016}"}}{tensors}}}'.encode()
    return struct.pack("<Q", len(header)) + header + bytes(64)


def call(module: str, name: str, reduces: bool) -> bytes:
    push = b"".join(b"\x8c" + bytes([len(x)]) + x.encode() + b"\x94" for x in (module, name))
    return b"\x80\x04" + push + b"\x93\x94" + (b"\x8c\x02id\x94\x85\x94R\x94." if reduces else b".")


def archive(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def content(k: int, segment: str) -> bytes:
    """The file of a customer."""
    module, name, reduces = MODULES[k % len(MODULES)], NAMES[k % len(NAMES)], k % 2 == 1
    if k % 7 == 0:
        return gguf(k, segment)
    if k % 7 == 1:
        return safetensors(k)
    if k % 7 == 2:
        return archive({"archive/data.pkl": call(module, name, reduces), "archive/version": b"3\n"})
    if k % 7 == 3:
        return f"c{module}\n{name}\n".encode() + (b"(S'id'\ntR." if reduces else b".")
    if k % 7 == 4:
        return b"\x80\x04c" + f"{module}\n{name}\n".encode() + b"\x8c\x20abc"
    if k % 7 == 5:
        return b"\x08\x07"
    noise = b"".join(hashlib.sha256(f"{k}/{i}".encode()).digest() for i in range(_DIGESTS))
    return b"\x80\x04B" + struct.pack("<I", len(noise)) + noise + b"."


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of customers, a few hundred a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, _A_BATCH):
            keys, segments = (c.to_pylist() for c in batch.slice(at, _A_BATCH).columns)
            yield pa.RecordBatch.from_arrays([pa.array([f"c/{k}.{EXTENSIONS[k % 7]}" for k in keys]), pa.array([content(k, s) for k, s in zip(keys, segments)], pa.binary())], names=["path", "content"])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and segments, dealt out before any bytes are made."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment").repartition(spark.sparkContext.defaultParallelism)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``, a file for each customer."""
    return _customers(spark, sf_dir).mapInArrow(_made, "path string, content binary")


def decoded(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """What these files hold: made and decoded in the same worker, so that no file travels."""
    decode = decoding(raw)
    return _customers(spark, sf_dir).mapInArrow(lambda batches: decode(_made(batches)), DECODED)


# the same facts in DuckDB's SQL


def _pick(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(k % {len(values)} AS INTEGER) + 1]"


#: One row a file: key, kind, path and what its parts are.
_FILES = f"""c0 AS (SELECT c_custkey AS k, CAST(c_custkey % 7 AS INTEGER) AS kind, c_mktsegment AS seg FROM customer),
c AS (SELECT *, 'c/' || k || '.' || {oracle.quoted_list(EXTENSIONS)}[kind + 1] AS path, {_pick(MODULES)} AS module, {_pick(NAMES)} AS name, k % 2 = 1 AS reduces,
  '{{"__metadata__":{{"trained_by":"/home/u' || k || '/run","format":"pt","n":3,"aws":"AKIA' || lpad(CAST(k AS VARCHAR), 16, '0') || '"}}' || CASE k % 3 WHEN 0 THEN ',"w0":{{}}' WHEN 1 THEN ',"w0":{{}},"w1":{{}}' ELSE ',"w0":{{}},"w1":{{}},"w2":{{}}' END || '}}' AS header FROM c0),
s AS (SELECT *, CASE kind WHEN 2 THEN 'archive:archive/data.pkl' ELSE 'archive:legacy.pkl' END AS stream,
  CAST(CASE kind WHEN 2 THEN 10 + length(module) + length(name) + CASE WHEN reduces THEN 10 ELSE 1 END WHEN 3 THEN 3 + length(module) + length(name) + CASE WHEN reduces THEN 10 ELSE 1 END WHEN 4 THEN 10 + length(module) + length(name) ELSE {8 + 32 * _DIGESTS} END AS BIGINT) AS n,
  CAST(CASE kind WHEN 2 THEN 8 + length(module) + length(name) WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS place, kind IN (2, 3) AND reduces AS called FROM c WHERE kind IN (2, 3, 4, 6))"""

_STRING = "8 + length({})"
_SIZE = f"""CAST(CASE kind WHEN 0 THEN 24 + {_STRING.format("'general.author'")} + 4 + {_STRING.format("'user' || k || ' <user' || k || '@example.com>'")} + {_STRING.format("'count'")} + 8 + {_STRING.format("'tags'")} + 16 + {_STRING.format("seg")} + {_STRING.format("'t' || k")} + {_STRING.format("'general.name'")} + 4 + {_STRING.format("seg")}
  WHEN 1 THEN 72 + length(header) WHEN 2 THEN (SELECT s.n FROM s WHERE s.k = c.k) + 2 + 22 + 2 * 76 + 2 * (length('archive/data.pkl') + length('archive/version')) WHEN 5 THEN 2 ELSE (SELECT s.n FROM s WHERE s.k = c.k) END AS BIGINT)"""
_FORMAT = "['gguf', 'safetensors', 'pytorch-zip', 'pytorch-legacy-pickle', 'pytorch-legacy-pickle', 'onnx', 'pytorch-legacy-pickle'][kind + 1]"
_TENSORS = "CASE kind WHEN 0 THEN CAST(k % 50 AS BIGINT) WHEN 1 THEN CAST(k % 3 + 1 AS BIGINT) END"
_KV = "CAST(CASE WHEN kind < 2 THEN 3 ELSE 0 END AS BIGINT)"

ARTIFACTS = f"WITH {_FILES} SELECT path, {_SIZE} AS size, {_FORMAT} AS format, {_TENSORS} AS tensor_count, {_KV} AS n_kv FROM c"
PAIRS = {
    "gguf": f"WITH {_FILES} SELECT path, CAST(i AS INTEGER) AS ord, ['general.author', 'tags', 'general.name'][i + 1] AS key, CASE i WHEN 0 THEN 'user' || k || ' <user' || k || '@example.com>' WHEN 1 THEN seg || ' t' || k ELSE seg END AS value FROM c, range(3) AS r(i) WHERE kind = 0",
    "safetensors": f"WITH {_FILES} SELECT path, CAST(i AS INTEGER) AS ord, ['aws', 'format', 'trained_by'][i + 1] AS key, CASE i WHEN 0 THEN 'AKIA' || lpad(CAST(k AS VARCHAR), 16, '0') WHEN 1 THEN 'pt' ELSE '/home/u' || k || '/run' END AS value FROM c, range(3) AS r(i) WHERE kind = 1",
}
STREAMS = f"WITH {_FILES} SELECT path, 0 AS ord, stream AS name, n AS size FROM s"
DISASSEMBLY = f"""WITH {_FILES} SELECT path, stream AS name, called AS has_reduce, kind = 4 AS truncated, CASE WHEN kind = 4 THEN n - 3 END AS stop_offset, CASE WHEN kind = 6 THEN '' ELSE module || ' ' || name || ' ' || place END AS imports FROM s"""

_RULES = ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s, _) in enumerate(dims.IMPORT_RULES))
_FULL = "module || '.' || name"
#: Findings of all scanners: scanner's and finding's place, and what a report shows of it.
_FOUND = f"""r AS (SELECT * FROM (VALUES {_RULES}) AS r(o, pattern, severity)),
i AS (SELECT *, (SELECT arg_min(severity, o) FROM r WHERE CASE WHEN pattern LIKE '%.' THEN s.module = rtrim(pattern, '.') OR starts_with(s.module, pattern) ELSE s.module || '.' || s.name = pattern END) AS danger,
  module = 'torch' OR starts_with(module, 'torch.') OR starts_with(module, 'numpy') OR module IN ('collections', '__builtin__', 'builtins') AS benign FROM s WHERE kind IN (2, 3, 4)),
noise AS (SELECT k, path, stream, '80044200200000' || string_agg(sha256(k || '/' || d), '' ORDER BY d) AS h FROM s, range({_DIGESTS}) AS g(d) WHERE kind = 6 GROUP BY ALL),
byte AS (SELECT path, stream, unnest(list_transform(range(4096), lambda j: substr(h, j * 2 + 1, 2))) AS b FROM noise),
e AS (SELECT path, stream, -sum(p * log2(p)) AS h FROM (SELECT path, stream, lower(b) AS b, count(*) / 4096 AS p FROM byte GROUP BY ALL) GROUP BY ALL),
f AS (
SELECT path, 'pickle' AS scanner, 0 AS major, 0 AS minor, 'THK-PKL-090' AS rule_id, 'medium' AS severity, 0.5::DOUBLE AS confidence, 'Unparseable / truncated pickle stream' AS title, stream AS component, n - 3 AS "offset", NULL AS evidence FROM s WHERE kind = 4
UNION ALL SELECT path, 'pickle', 0, 1, CASE WHEN danger IS NULL THEN 'THK-PKL-002' ELSE 'THK-PKL-001' END, coalesce(danger, 'low'), CASE WHEN danger IS NULL THEN 0.4 WHEN called THEN 0.97 ELSE 0.85 END::DOUBLE,
  CASE WHEN danger IS NULL THEN 'Unexpected pickle import: ' ELSE 'Dangerous pickle import: ' END || {_FULL}, stream, place, CASE WHEN danger IS NOT NULL THEN 'GLOBAL ' || {_FULL} END FROM i WHERE danger IS NOT NULL OR NOT benign
UNION ALL SELECT path, 'secrets', 0, 0, 'THK-SEC-001', 'critical', 0.95::DOUBLE, 'AWS access key id embedded in artifact', 'raw', CAST(strpos(header, 'AKIA') + 7 AS BIGINT), 'AKIA…' || right(lpad(CAST(k AS VARCHAR), 16, '0'), 4) || ' (20 chars)' FROM c WHERE kind = 1
UNION ALL SELECT path, 'pii', 0, 0, 'THK-PII-001', 'low', 0.7::DOUBLE, 'Email address in metadata field `general.author`', 'metadata:general.author', NULL, {oracle.redact("'user' || k || '@example.com'")} FROM c WHERE kind = 0
UNION ALL SELECT path, 'metadata', 2, 0, 'THK-MET-001', 'low', 0.85::DOUBLE, 'Absolute build path leaks a username/host', 'metadata:trained_by', NULL, '/home/u' || k FROM c WHERE kind = 1
UNION ALL SELECT path, 'metadata', 99, 0, 'THK-MET-000', 'info', 1.0::DOUBLE, 'Artifact inventory', 'header', NULL, NULL FROM c WHERE kind < 2
UNION ALL SELECT path, 'entropy', 0, 0, 'THK-ENT-001', 'medium', 0.5::DOUBLE, 'High-entropy region inside pickle stream', stream, 0, NULL FROM e WHERE h >= {dims.ENTROPY_THRESHOLD})"""
WITH = f"WITH {_FILES}, {_FOUND}"
_COLUMNS = 'path, rule_id, scanner, severity, confidence, title, component, CAST("offset" AS BIGINT) AS "offset", evidence'
FINDINGS = f"{WITH} SELECT {_COLUMNS} FROM f"
PICKLE_FINDINGS = f"{WITH} SELECT {_COLUMNS} FROM f WHERE scanner = 'pickle'"
ENTROPY = f"{WITH} SELECT path, stream AS component, 0::BIGINT AS \"offset\", printf('%.2f', h) AS entropy FROM e WHERE h >= {dims.ENTROPY_THRESHOLD}"
_RAW = f"sum({oracle.weight('severity')} * CAST(confidence AS DECIMAL(4, 2)))"
_COUNTS = tuple(reversed(dims.SEVERITIES))
REPORTS = f"""{WITH}, g AS (SELECT path, {_RAW} AS raw, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in _COUNTS)}, CAST(max({oracle.sev_ord('severity')}) AS INTEGER) AS worst FROM f GROUP BY path)
SELECT c.path, {_FORMAT} AS format, {_SIZE} AS size, {oracle.risk('coalesce(raw, 0)')} AS risk_score, {', '.join(f'coalesce({s}, 0) AS {s}' for s in _COUNTS)}, worst FROM c LEFT JOIN g USING (path)"""


def findings(found: DataFrame) -> DataFrame:
    return found.select("path", "rule_id", "scanner", "severity", "confidence", "title", "location.component", "location.offset", "evidence")


def entropy(found: DataFrame) -> DataFrame:
    """Place of each noisy window and its entropy, from the finding's text."""
    return found.filter("scanner = 'entropy'").select("path", "location.component", "location.offset", F.regexp_extract("detail", r"have (\d\.\d\d) bits", 1).alias("entropy"))
