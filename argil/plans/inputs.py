"""Inputs of the queries: driver tables in the shape of the engine's, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argil.api import text_as_metadata

#: Metadata pairs made of each customer, one for each rule that the text tables never match. Both dialects read these expressions.
CUSTOMER_PAIRS = (
    ("owner_ssn", "'ssn ' || lpad(CAST(c_custkey % 900 + 100 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0') || '-' || lpad(CAST(c_custkey % 9000 + 1000 AS STRING), 4, '0')"),
    ("owner_id", "lpad(CAST(c_custkey % 9000 + 1000 AS STRING), 4, '0') || ' ' || lpad(CAST(c_custkey % 7000 + 1000 AS STRING), 4, '0') || ' 2468 end'"),
    ("tax_id", "'pan ' || translate(lpad(CAST(c_custkey AS STRING), 5, '0'), '0123456789', 'ABCDEFGHIJ') || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || 'K'"),
    ("account", "'iban DE' || lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0') || lpad(CAST(c_custkey AS STRING), 18, '0')"),
    ("trained_by", "CASE c_custkey % 3 WHEN 0 THEN '/home/user' || CAST(c_custkey AS STRING) || '/run' WHEN 1 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'u' || CAST(c_custkey AS STRING) || chr(92) || 'w' ELSE 'local' END"),
    ("tracking", "'see https://mlflow.corp.internal/run/' || CAST(c_custkey AS STRING) || ' and s3://bucket/' || c_mktsegment"),
    ("aws_key", "'AKIA' || upper(lpad(CAST(c_custkey AS STRING), 16, '0'))"),
    ("contact", "'user' || CAST(c_custkey AS STRING) || '@example.com from 10.0.' || CAST(c_custkey % 256 AS STRING) || '.7'"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; one of fewer files than there are cores is dealt out, as a file may be a single row group, which one task
    reads. Tables of many files stay as they are."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if len(found.inputFiles()) < cores else found


def documents_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_metadata(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def pages_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_metadata(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


def urls_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_metadata(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")


def customer_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as an artifact with eight pairs, exploded from one scan."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.expr(e).alias("value")) for i, (k, e) in enumerate(CUSTOMER_PAIRS)))
    return customers.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"), F.explode(pairs).alias("p")).select("path", "p.*")


DOCUMENTS_SQL = "(SELECT CAST(doc_id AS VARCHAR) AS path, 0 AS ord, 'text' AS key, text AS value FROM documents)"
PAGES_SQL = "(SELECT CAST(page_id AS VARCHAR) AS path, 0 AS ord, 'html' AS key, html AS value FROM pages)"
URLS_SQL = "(SELECT CAST(page_id AS VARCHAR) AS path, 0 AS ord, 'url' AS key, url AS value FROM pages)"
CUSTOMER_SQL = "(" + " UNION ALL ".join(f"SELECT 'customer/' || c_custkey AS path, {i} AS ord, '{k}' AS key, {e} AS value FROM customer" for i, (k, e) in enumerate(CUSTOMER_PAIRS)) + ")"

#: Byte heads of files of each format, with a name that may decide: (path, hex).
FILES = (
    ("a/model.gguf", "47475546030000000000000000000000"),
    ("a/model.ggml", "47474D4C01000000"),
    ("a/model.bin", "504B03041400000000000000"),
    ("a/empty.bin", "504B050600000000"),
    ("a/net.onnx", "080712076261636B656E64"),
    ("a/NET.ONNX", "080712076261636B656E64"),
    ("a/named.onnx", "4747554603000000"),
    ("a/weights.safetensors", "40000000000000007B225F5F"),
    ("a/zero.safetensors", "00000000000000007B225F5F"),
    ("a/short.safetensors", "40000000000000"),
    ("a/p4.pkl", "80049508"),
    ("a/p0.pt", "636F730A73797374656D0A"),
    ("a/list.ckpt", "5D2E"),
    ("a/dict.pth", "7D712E"),
    ("a/only80", "80"),
    ("a/readme.txt", "68656C6C6F"),
    ("a/.bin", "00"),
    ("a/none", ""),
)


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, bytearray.fromhex(h)) for p, h in FILES], "path string, content binary")


FILES_SQL = "(VALUES " + ", ".join(f"('{p}', '{h}')" for p, h in FILES) + ") AS f(path, hex)"

MODULES = ("os", "posix", "subprocess.run", "builtins", "__builtin__", "sys", "importlib.util", "collections", "collections.abc", "torch", "torch.nn", "torchx", "numpy.core", "numpyfoo", "operator", "_codecs", "codecs", "base64", "copyreg", "osx", "pickle", "http.client")
NAMES = ("system", "eval", "exec", "compile", "open", "getattr", "attrgetter", "itemgetter", "print", "_reconstructor", "encode", "OrderedDict", "__import__")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import for each part, module and name cycling through all that matter."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = [F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % len(v)).cast("int") + 1) for v in (MODULES, NAMES)]
    return part.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), pick[0].alias("module"), pick[1].alias("name"), (F.col("p_size") % 2 == 0).alias("has_reduce"))


IMPORTS_SQL = "(SELECT 'part/' || p_partkey AS path, [" + ", ".join(f"'{m}'" for m in MODULES) + f"][CAST(p_partkey % {len(MODULES)} AS INTEGER) + 1] AS module, [" + ", ".join(f"'{n}'" for n in NAMES) + f"][CAST(p_partkey % {len(NAMES)} AS INTEGER) + 1] AS name, p_size % 2 = 0 AS has_reduce FROM part)"
