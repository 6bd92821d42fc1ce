"""All queries of the library by name, and the DuckDB SQL of those that SQL can express.

Each query applies one operator to a whole table. Text tables stand in for metadata; where they never match a rule, pairs made of
the customers do; container formats are exercised by byte strings in code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argil import __version__, api
from argil.functions import dims, rules
from argil.functions import expressions as X
from argil.operators import entropy, metadata, packs, pickles, pii, report, secrets
from argil.operators.findings import at_least, gates, new_since, ordered, worst
from argil.plans import containers, inputs, oracle
from argil.sources import files

Query = Callable[[SparkSession, str], DataFrame]
Kv = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_RULES = {r.rule_id: r for r in dims.PII_RULES}
_TEXTS: dict[str, tuple[tuple[Kv, str], ...]] = {
    "text": ((inputs.documents_kv, inputs.DOCUMENTS_SQL), (inputs.pages_kv, inputs.PAGES_SQL)),
    "customer": ((inputs.customer_kv, inputs.CUSTOMER_SQL),),
}


# personal data, rule by rule


def _pii(rule: dims.Rule, sources: tuple[tuple[Kv, str], ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kv, _ in sources:
        found = pii.exploded(kv(spark, sf_dir), (rule,))
        part = found.select("path", "key", X.redact(F.col("hit")).alias("evidence"))
        out = part if out is None else out.union(part)
    return out


def _pii_sql(rule: dims.Rule, sources: tuple[tuple[Kv, str], ...]) -> str:
    return " UNION ALL ".join(f"SELECT path, key, {oracle.redact('hit')} AS evidence FROM ({oracle.hits(sql, rule)})" for _, sql in sources)


for _name, _id, _source in (
    ("pii_email", "THK-PII-001", "text"),
    ("pii_card_luhn", "THK-PII-002", "text"),
    ("pii_ipv4", "THK-PII-007", "text"),
    ("pii_ssn", "THK-PII-003", "customer"),
    ("pii_aadhaar", "THK-PII-004", "customer"),
    ("pii_pan", "THK-PII-005", "customer"),
    ("pii_iban", "THK-PII-006", "customer"),
):
    _add(_name, partial(_pii, _RULES[_id], _TEXTS[_source]), _pii_sql(_RULES[_id], _TEXTS[_source]))


# metadata rules


def _met(rule: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.exploded(inputs.customer_kv(spark, sf_dir)).filter(F.col("rule") == rule).select("path", "key", F.col("hit").alias("evidence"))


def _met_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = inputs.customer_kv(spark, sf_dir).union(inputs.urls_kv(spark, sf_dir))
    return metadata.exploded(kv).filter("rule = 2").select("path", "key", "n", F.col("hit").alias("evidence"))


_add("met_path", partial(_met, 0), f"SELECT path, key, hit AS evidence FROM ({oracle.path_hits(inputs.CUSTOMER_SQL)})")
_add("met_cloud", partial(_met, 1), f"SELECT path, key, hit AS evidence FROM ({oracle.hits(inputs.CUSTOMER_SQL, metadata.CLOUD)})")
_add("met_url", _met_url, " UNION ALL ".join(f"SELECT path, key, CAST(n AS INTEGER) AS n, hit AS evidence FROM ({oracle.hits(x, metadata.LINKS)})" for x in (inputs.CUSTOMER_SQL, inputs.URLS_SQL)))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as artifacts, a third of which declare a number of tensors, and orders as their metadata."""
    customers, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    count = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 100).alias("tensor_count")
    own = customers.select(F.col("c_custkey").cast("string").alias("path"), count)
    kv = orders.select(F.col("o_custkey").cast("string").alias("path"))
    return metadata.scan_inventory(metadata.counted(own, kv)).select("path", "rule_id", "severity", "confidence", "detail")


_add(
    "met_inventory",
    _inventory,
    """SELECT CAST(c_custkey AS VARCHAR) AS path, 'THK-MET-000' AS rule_id, 'info' AS severity, CAST(1.0 AS DOUBLE) AS confidence,
    'Parsed ' || coalesce(n, 0) || ' metadata key(s); container declares ' || CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 100 AS VARCHAR) ELSE '?' END || ' tensor(s).' AS detail
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 0 OR c_custkey % 3 = 0""",
)

# secrets


def _aws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_text(inputs.customer_kv(spark, sf_dir), dims.SECRET_RULES[:1]).select("path", "rule_id", "severity", "confidence", F.col("location.component").alias("component"), "evidence")


_add("sec_aws_key", _aws, f"SELECT path, 'THK-SEC-001' AS rule_id, 'critical' AS severity, CAST(0.95 AS DOUBLE) AS confidence, 'metadata:' || key AS component, {oracle.redact('hit')} AS evidence FROM ({oracle.hits(inputs.CUSTOMER_SQL, dims.Rule('', '', '', 0, dims.SECRET_RULES[0].pattern, 1000))})")


def _secret_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family of credentials over documents, conversations and customers."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.lit(0).alias("ord"), F.lit("text").alias("key"), F.col("text").alias("value"))
    kv = inputs.documents_kv(spark, sf_dir).union(talk).union(inputs.customer_kv(spark, sf_dir))
    return secrets.scan_text(kv).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


_TALK_SQL = "SELECT conv_id || '/' || turn AS path, 0 AS ord, 'text' AS key, text AS value FROM conversations"
_ALL_SQL = f"(SELECT * FROM {inputs.DOCUMENTS_SQL} UNION ALL {_TALK_SQL} UNION ALL SELECT * FROM {inputs.CUSTOMER_SQL})"
_add("secret_families", _secret_families, "SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS n_paths FROM (" + " UNION ALL ".join(f"SELECT path, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity FROM ({oracle.hits('kv', dims.Rule('', '', '', 0, r.pattern, 100000))})" for r in dims.SECRET_RULES) + ") GROUP BY ALL")
ORACLE_SQL["secret_families"] = f"WITH kv AS {_ALL_SQL} " + ORACLE_SQL["secret_families"]

# scalars


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("value"))
    return _documents(spark, sf_dir).select(F.col("text").alias("value")).union(parts).select(X.redact(F.col("value")).alias("evidence"))


_add("redact_evidence", _redact, f"SELECT {oracle.redact('value')} AS evidence FROM (SELECT text AS value FROM documents UNION ALL SELECT unnest([p_name, p_brand, p_type]) FROM part)")


def _human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = (F.col("o_orderkey") * F.col("o_orderkey") * (F.col("o_custkey") % 1000)).alias("n")
    return orders.select("o_orderkey", n).select("o_orderkey", X.human_bytes(F.col("n")).alias("size"))


_add("human_bytes", _human_bytes, f"SELECT o_orderkey, {oracle.human_bytes('n')} AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_custkey % 1000) AS n FROM orders)")


def _score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("p_partkey") % 101).cast("int")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", score.alias("score"), X.score_band(score).alias("band"))


_add("score_band", _score_band, "SELECT p_partkey, CAST(p_partkey % 101 AS INTEGER) AS score, CASE WHEN p_partkey % 101 >= 60 THEN 'red' WHEN p_partkey % 101 >= 20 THEN 'yellow' ELSE 'green' END AS band FROM part")


def _severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.severity_name(F.col("s_suppkey") % 5)
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", name.alias("severity"))
    return own.select("*", X.sarif_level(F.col("severity")).alias("level"), X.sev_weight(F.col("severity")).alias("weight"), X.sev_ord(F.col("severity")).alias("sev_ord"))


_add("sarif_level", _severities, f"SELECT s_suppkey, severity, {oracle.case('severity', dims.SARIF_LEVELS)} AS level, {oracle.weight('severity')} AS weight, {oracle.sev_ord('severity')} AS sev_ord FROM (SELECT s_suppkey, ['info', 'low', 'medium', 'high', 'critical'][s_suppkey % 5 + 1] AS severity FROM supplier)")


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", X.clamp(F.col("c_acctbal") / 5000).alias("confidence"))


_add("confidence_clamp", _confidence, "SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS confidence FROM customer")


def _luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "4"), F.lit("-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", number.alias("number")).select("o_orderkey", X.luhn_ok(F.col("number")).alias("ok"))


_add("luhn_check", _luhn, f"SELECT o_orderkey, {oracle.luhn('number')} AS ok FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '4') || '-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS number FROM orders)")


# findings


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.scan_text(inputs.documents_kv(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.scan_text(inputs.documents_kv(spark, sf_dir).union(inputs.customer_kv(spark, sf_dir)))


_MIXED_SQL = f"(SELECT * FROM {inputs.DOCUMENTS_SQL} UNION ALL SELECT * FROM {inputs.CUSTOMER_SQL})"
_WITH = f"WITH kv AS {_MIXED_SQL}, f AS ({oracle.findings('kv')}) "
_WITH_DOCUMENTS = f"WITH kv AS {inputs.DOCUMENTS_SQL}, f AS ({oracle.findings('kv')}) "
_RAW = f"sum({oracle.weight('severity')} * CAST(confidence AS DECIMAL(4, 2)))"
_COUNTS_SQL = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in report.COUNTS)
_COLUMNS = ("path", "rule_id", "scanner", "severity", "confidence")

_add("findings_union", lambda s, d: _mixed(s, d).select(*_COLUMNS, F.col("location.component").alias("component")), f"{_WITH} SELECT {', '.join(_COLUMNS)}, 'metadata:' || key AS component FROM f")


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each finding in its report, worst first."""
    order = Window.partitionBy("path").orderBy(F.desc("sev_ord"), F.desc("confidence"), "seq")
    return _mixed(spark, sf_dir).withColumn("place", F.row_number().over(order)).select("path", "place", "rule_id", "severity")


_SCANNER_ORDER = oracle.case("scanner", {s: i for i, s in enumerate(dims.SCANNERS)})
_add("findings_sorted", _sorted, f"{_WITH} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY {oracle.sev_ord('severity')} DESC, confidence DESC, {_SCANNER_ORDER}, (SELECT min(kv.ord) FROM kv WHERE kv.key = f.key), rule_id, n) AS INTEGER) AS place, rule_id, severity FROM f")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the order of reports; ``place`` is where the sorted table has them within their path."""
    at = ordered(_findings(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("at"))).select("path", "place", "rule_id", "severity", "confidence")


_PLACE = f"CAST(row_number() OVER (PARTITION BY path ORDER BY {oracle.sev_ord('severity')} DESC, confidence DESC, {_SCANNER_ORDER}, rule_id, n) AS INTEGER)"
_add("findings_ranked", _ranked, f"{_WITH_DOCUMENTS} SELECT path, {_PLACE} AS place, rule_id, severity, confidence FROM f")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a finding says."""
    texts = (F.array_join(F.coalesce("references", F.array().cast("array<string>")), "; ").alias("references"), F.coalesce("remediation", F.lit("")).alias("remediation"))
    return _mixed(spark, sf_dir).select("path", "rule_id", "title", "detail", "location.component", *texts, "evidence")


_add("findings_whole", _whole, f"{_WITH} SELECT path, rule_id, title, detail, 'metadata:' || key AS component, refs AS \"references\", remediation, evidence FROM (SELECT *, {oracle.texts('rule_id')} FROM f)")

_add("severity_summary", lambda s, d: report.scores(_mixed(s, d)).select("path", *report.COUNTS), f"{_WITH} SELECT path, {_COUNTS_SQL} FROM f GROUP BY path")
_add("risk_score", lambda s, d: report.scores(_findings(s, d)).select("path", "risk_score"), f"{_WITH_DOCUMENTS} SELECT path, {oracle.risk(_RAW)} AS risk_score FROM f GROUP BY path")
_add("risk_score_mixed", lambda s, d: report.scores(_mixed(s, d)).select("path", F.col("raw").cast("double").alias("raw"), "risk_score"), f"{_WITH} SELECT path, CAST({_RAW} AS DOUBLE) AS raw, {oracle.risk(_RAW)} AS risk_score FROM f GROUP BY path")
_add("worst_severity", lambda s, d: report.scores(_mixed(s, d)).select("path", "worst", X.severity_name(F.col("worst")).alias("severity")), f"{_WITH}, w AS (SELECT path, CAST(max({oracle.sev_ord('severity')}) AS INTEGER) AS worst FROM f GROUP BY path) SELECT path, worst, ['info', 'low', 'medium', 'high', 'critical'][worst + 1] AS severity FROM w")
_add("worst_overall", lambda s, d: worst(_findings(s, d)), f"{_WITH_DOCUMENTS} SELECT CAST(coalesce(max({oracle.sev_ord('severity')}), 0) AS INTEGER) AS worst FROM f")
_add("min_severity_filter", lambda s, d: at_least(_mixed(s, d), "medium").select(*_COLUMNS), f"{_WITH} SELECT {', '.join(_COLUMNS)} FROM f WHERE {oracle.sev_ord('severity')} >= 2")


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code for each threshold, also where a filter hides what is worse: one aggregation, then a row for each pair."""
    pairs = (("info", "info"), ("info", "high"), ("info", "critical"), ("critical", "high"), ("medium", "medium"))
    codes = gates(_findings(spark, sf_dir), pairs)
    return codes.select(F.explode("gates").alias("g")).select("g.*")


_add("ci_gate", _gates, f"{_WITH_DOCUMENTS}, o AS (SELECT {oracle.sev_ord('severity')} AS o FROM f) SELECT m AS min_severity, t AS fail_on, CAST(CASE WHEN coalesce((SELECT max(o) FROM o WHERE o >= a), 0) >= b THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM (VALUES ('info', 'info', 0, 0), ('info', 'high', 0, 3), ('info', 'critical', 0, 4), ('critical', 'high', 4, 3), ('medium', 'medium', 2, 2)) AS g(m, t, a, b)")



def _new_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of all customers finds that one of two thirds of them didn't."""
    kv = inputs.customer_kv(spark, sf_dir)
    old = kv.filter(F.substring_index("path", "/", -1).cast("long") % 3 != 0)
    return new_since(api.scan_text(kv), api.scan_text(old)).select(*_COLUMNS)


_add("baseline_diff", _new_since, f"WITH kv AS {inputs.CUSTOMER_SQL}, f AS ({oracle.findings('kv')}) SELECT {', '.join(_COLUMNS)} FROM f WHERE CAST(split_part(path, '/', 2) AS BIGINT) % 3 = 0")


def _first_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first path, as the single-run rendering of many targets gives it."""
    return report.scores(_findings(spark, sf_dir)).orderBy("path").limit(1).select("path", "risk_score")


_add("first_report", _first_report, f"{_WITH_DOCUMENTS} SELECT path, {oracle.risk(_RAW)} AS risk_score FROM f GROUP BY path ORDER BY path LIMIT 1")

# entropy


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("bytes"))


def _entropy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.windows(_bytes(spark, sf_dir), ["doc_id"]).select("doc_id", "off", F.round("entropy", 6).alias("entropy"))


def _entropy_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.windows_native(_bytes(spark, sf_dir), ["doc_id"]).select("doc_id", "off", F.round("entropy", 6).alias("entropy"))


def _entropy_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.windows(_bytes(spark, sf_dir), ["doc_id"], threshold=4.3).select("doc_id", "off", F.round("entropy", 4).alias("entropy"))


_ENTROPY = """WITH w AS (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, strlen(text) - 4095, 4096)) AS off FROM documents),
b AS (SELECT doc_id, off, unnest(list_transform(range(0, 4096), lambda i: substr(h, (off + i) * 2 + 1, 2))) AS byte FROM w),
c AS (SELECT doc_id, off, byte, count(*) / 4096 AS p FROM b GROUP BY ALL),
e AS (SELECT doc_id, CAST(off AS INTEGER) AS off, -sum(p * log2(p)) AS entropy FROM c GROUP BY doc_id, off) """
for _name, _query in (("entropy_windows", _entropy_windows), ("entropy_windows_native", _entropy_native)):
    _add(_name, _query, _ENTROPY + "SELECT doc_id, off, round(entropy, 6) AS entropy FROM e")
_add("entropy_first_hit", _entropy_first, _ENTROPY + "SELECT doc_id, min(off) AS off, round(min_by(entropy, off), 4) AS entropy FROM e WHERE entropy >= 4.3 GROUP BY doc_id")

# formats and targets

_FORMAT_SQL = f"""SELECT path, CASE WHEN hex[1:8] = '47475546' THEN 'gguf' WHEN hex[1:8] = '47474D4C' THEN 'ggml' WHEN hex[1:8] = '504B0304' THEN 'pytorch-zip'
WHEN lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) = 'onnx' THEN 'onnx' WHEN length(hex) >= 18 AND hex[1:16] <> '0000000000000000' AND hex[17:18] = '7B' THEN 'safetensors'
WHEN hex[1:2] = '80' OR (hex[1:2] IN ('28', '63', '7D', '5D') AND length(hex) > 4) THEN 'pytorch-legacy-pickle' ELSE 'unknown' END AS format FROM {inputs.FILES_SQL}"""
_add("format_detect", lambda s, d: inputs.files(s).select("path", X.detect_format(F.col("path"), F.col("content")).alias("format")), _FORMAT_SQL)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat("url", F.element_at(F.array(*map(F.lit, (".bin", ".BIN", ".gguf", "", ".pt", ".tar.ckpt", "/.pkl"))), (F.col("page_id") % 7).cast("int") + 1)).alias("path"))
    return names.select("path", X.is_candidate(F.col("path")).alias("candidate"))


_add("candidate_filter", _candidates, "SELECT path, regexp_extract(path, '[^/]\\.([^./]+)$', 1) IN (" + ", ".join(f"'{e}'" for e in dims.CANDIDATE_EXTENSIONS) + ") AS candidate FROM (SELECT url || ['.bin', '.BIN', '.gguf', '', '.pt', '.tar.ckpt', '/.pkl'][CAST(page_id % 7 AS INTEGER) + 1] AS path FROM pages)")

# imports

_DANGEROUS = ", ".join(f"({i}, '{p}', '{s}', {oracle.quoted(w)})" for i, (p, s, w) in enumerate(dims.IMPORT_RULES))
_CLASSIFIED = f"""WITH r AS (SELECT * FROM (VALUES {_DANGEROUS}) AS r(o, pattern, severity, why)), i AS (SELECT * FROM {inputs.IMPORTS_SQL}),
c AS (SELECT path, module, name, has_reduce, (SELECT arg_min(severity, o) FROM r WHERE CASE WHEN pattern LIKE '%.' THEN i.module = rtrim(pattern, '.') OR starts_with(i.module, pattern) ELSE i.module || '.' || i.name = pattern END) AS severity,
module = 'torch' OR starts_with(module, 'torch.') OR starts_with(module, 'numpy') OR module IN ('collections', '__builtin__', 'builtins') AS benign FROM i) """
_add("import_classify", lambda s, d: pickles.classified(inputs.imports(s, d)).filter("severity IS NOT NULL").select("path", "module", "name", "severity", F.when(F.col("has_reduce"), 0.97).otherwise(0.85).cast("double").alias("confidence")), _CLASSIFIED + "SELECT path, module, name, severity, CAST(CASE WHEN has_reduce THEN 0.97 ELSE 0.85 END AS DOUBLE) AS confidence FROM c WHERE severity IS NOT NULL")
_add("import_unexpected", lambda s, d: pickles.unexpected(inputs.imports(s, d)).select("path", "module", "name"), _CLASSIFIED + "SELECT path, module, name FROM c WHERE severity IS NULL AND NOT benign")
_add("import_benign", lambda s, d: pickles.classified(inputs.imports(s, d)).filter("severity IS NULL AND benign").select("path", "module", "name"), _CLASSIFIED + "SELECT path, module, name FROM c WHERE severity IS NULL AND benign")

# rule packs

PACK = r"""
MODEL_RULE cloud_user { meta: id = "ORG-001" severity = high target: metadata strings: $a = /s3:\/\/bucket/ $b = "/home/" condition: $a and $b }
MODEL_RULE no_contact { meta: id = "ORG-002" severity = low target: metadata strings: $m = /user1[0-9]*@example\.com/ condition: not $m }
MODEL_RULE either { meta: id = "ORG-003" target: metadata strings: $p = /\b[A-Z]{5}\d{4}K\b/ $b = "BUILDING" $u = /C:\\Users/ condition: $p and ($b or $u) and not import("torch.*") }
"""


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.text_scan(inputs.customer_kv(spark, sf_dir), rules.load(PACK))


_HAS = "bool_or(regexp_matches(value, {}))"
_add(
    "rule_pack",
    _pack,
    f"""WITH f AS (SELECT path, {_HAS.format("'s3://bucket'")} AS a, {_HAS.format("'/home/'")} AS b, {_HAS.format("'user1[0-9]*@example[.]com'")} AS m, {_HAS.format("'[A-Z]{5}[0-9]{4}K'")} AS p, {_HAS.format("'BUILDING'")} AS g, {_HAS.format("'C:.Users'")} AS u FROM {inputs.CUSTOMER_SQL} GROUP BY path)
    SELECT path, 'ORG-001' AS rule_id FROM f WHERE a AND b UNION ALL SELECT path, 'ORG-002' FROM f WHERE NOT m UNION ALL SELECT path, 'ORG-003' FROM f WHERE p AND (g OR u)""",
)

# containers, made of the customers


_examined = containers.decoded


def _scan(spark: SparkSession, sf_dir: str, scanners: Mapping[str, api.Scanner] | None = None) -> api.Scan:
    return api.scan_binary(containers.files(spark, sf_dir), scanners, containers.decoded(spark, sf_dir, scanners is None))


def _disassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = F.array_join(F.transform("imports", lambda i: F.concat_ws(" ", i["module"], i["name"], i["offset"].cast("string"))), ",")
    return files.pickle_streams(_examined(spark, sf_dir)).select("path", "name", "has_reduce", "truncated", "stop_offset", imports.alias("imports"))


_add("artifact_scan", lambda s, d: files.artifacts(_examined(s, d)).withColumn("tensor_count", F.col("tensor_count").cast("long")), containers.ARTIFACTS)
for _kind in ("gguf", "safetensors"):
    _add(f"{_kind}_kv", lambda s, d, kind=_kind: files.metadata_kv(_examined(s, d)).filter(F.col("path").endswith(f".{kind}")), containers.PAIRS[_kind])
_add("zip_streams", lambda s, d: files.pickle_streams(_examined(s, d)).select("path", "ord", "name", "size"), containers.STREAMS)
_add("pickle_disasm", _disassembly, containers.DISASSEMBLY)
_add("pickle_findings", lambda s, d: containers.findings(pickles.scan(files.pickle_streams(_examined(s, d)))), containers.PICKLE_FINDINGS)
_add("entropy_findings", lambda s, d: containers.entropy(entropy.scan(files.pickle_streams(_examined(s, d)))), containers.ENTROPY)
_add("artifact_findings", lambda s, d: containers.findings(_scan(s, d).findings), containers.FINDINGS)
_add("artifact_reports", lambda s, d: _scan(s, d).reports().select("path", "format", "size", "risk_score", *report.COUNTS, "worst"), containers.REPORTS)


def _pack_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over metadata, raw bytes, imports and opcodes of all files."""
    scanner = packs.scanner(rules.load(FILE_PACK))
    return _scan(spark, sf_dir, {"rules": scanner}).findings.select("path", "rule_id", "severity")


FILE_PACK = r"""
MODEL_RULE author { meta: id = "ORG-101" severity = medium target: metadata strings: $u = /user\d+ </ condition: $u }
MODEL_RULE key { meta: id = "ORG-102" severity = high target: raw strings: $k = /AKIA[0-9]{16}/ condition: $k }
MODEL_RULE runs { meta: id = "ORG-103" severity = critical target: pickle condition: import("os.*") and opcode(REDUCE) }
MODEL_RULE quiet { meta: id = "ORG-104" severity = low target: pickle condition: not opcode(PROTO) and not import("posix.system") }
"""
_add(
    "rule_pack_files",
    _pack_on_files,
    f"""{containers.WITH} SELECT path, 'ORG-101' AS rule_id, 'medium' AS severity FROM c WHERE kind = 0 UNION ALL SELECT path, 'ORG-102', 'high' FROM c WHERE kind = 1
    UNION ALL SELECT path, 'ORG-103', 'critical' FROM s WHERE module = 'os' AND called UNION ALL SELECT path, 'ORG-104', 'low' FROM c WHERE kind NOT IN (2, 4, 6) AND NOT (kind = 3 AND module = 'posix' AND name = 'system')""",
)

# renderings


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    own = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit("unknown").alias("format"), F.octet_length("text").cast("long").alias("size"))
    return report.reports(own, _findings(spark, sf_dir))


_JSON = "struct<tool:string,target:string,format:string,bytes:long,risk_score:int,summary:struct<critical:long,high:long,medium:long,low:long,info:long>,findings:array<struct<rule_id:string,scanner:string,severity:string,confidence:double,title:string,detail:string,location:struct<component:string,offset:long>,references:array<string>,remediation:string,evidence:string>>>"
_SARIF = "struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,rules:array<string>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,properties:struct<scanner:string,confidence:double,severity:string,references:array<string>>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,logicalLocations:array<struct<name:string>>>>>>>>>>"


def _joined(references: str) -> Column:
    return F.array_join(F.coalesce(references, F.array().cast("array<string>")), "; ").alias("references")


def _json_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, read again: every field that a consumer sees, a row for each finding or one without."""
    read = _reports(spark, sf_dir).select(F.from_json(report.as_json(pretty=False), _JSON).alias("j")).select("j.*")
    each = read.select("tool", "target", "format", "bytes", "risk_score", "summary.*", F.posexplode_outer("findings").alias("at", "f"))
    return each.select("tool", "target", "format", "bytes", "risk_score", *report.COUNTS, F.col("at").cast("int").alias("spot"), "f.rule_id", "f.scanner", "f.severity", "f.confidence", "f.title", "f.detail", "f.location.component", _joined("f.references"), "f.remediation", "f.evidence")


def _sarif_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _reports(spark, sf_dir).select("path", F.from_json(report.as_sarif(pretty=False), _SARIF).alias("j"))
    each = read.select("path", "j.version", F.col("j.runs")[0].tool.driver.alias("d"), F.posexplode(F.col("j.runs")[0].results).alias("at", "r"))
    place = F.col("r.locations")[0].physicalLocation
    return each.select("path", "version", F.col("d.name").alias("tool"), F.size("d.rules").alias("n_rules"), F.col("at").cast("int").alias("spot"), "r.ruleId", "r.level", F.col("r.message.text").alias("message"), "r.properties.scanner", "r.properties.confidence", "r.properties.severity", _joined("r.properties.references"), place.artifactLocation.uri.alias("uri"), place.logicalLocations[0]["name"].alias("component"))


_SUMMED = f"g AS (SELECT path, {oracle.risk(_RAW)} AS risk_score, {_COUNTS_SQL} FROM f GROUP BY path), w AS (SELECT *, {_PLACE} - 1 AS spot, {oracle.texts('rule_id')} FROM f)"
_ALL_COUNTS = ", ".join(f"coalesce({s}, 0) AS {s}" for s in report.COUNTS)
_DOCUMENT = "documents LEFT JOIN g ON g.path = CAST(doc_id AS VARCHAR) LEFT JOIN w ON w.path = CAST(doc_id AS VARCHAR)"
_add(
    "report_json",
    _json_flat,
    f"{_WITH_DOCUMENTS}, {_SUMMED} SELECT 'argil' AS tool, CAST(doc_id AS VARCHAR) AS target, 'unknown' AS format, CAST(strlen(text) AS BIGINT) AS bytes, coalesce(risk_score, 0) AS risk_score, {_ALL_COUNTS}, CAST(spot AS INTEGER) AS \"spot\", rule_id, scanner, severity, confidence, title, detail, 'metadata:' || key AS component, coalesce(refs, '') AS \"references\", nullif(remediation, '') AS remediation, evidence FROM {_DOCUMENT}",
)
_add(
    "report_sarif",
    _sarif_flat,
    f"{_WITH_DOCUMENTS}, {_SUMMED} SELECT path, '2.1.0' AS version, 'argil' AS tool, 0 AS n_rules, CAST(spot AS INTEGER) AS \"spot\", rule_id AS \"ruleId\", {oracle.case('severity', dims.SARIF_LEVELS)} AS level, title || ': ' || detail AS message, scanner, confidence, severity, refs AS \"references\", path AS uri, 'metadata:' || key AS component FROM w",
)
_LINES = "'  ' || lpad(upper(severity), 8, ' ') || '  ' || title || '  (' || printf('%.0f', confidence * 100) || '% conf)' || chr(10) || repeat(' ', 11) || rule_id || ' · ' || scanner || ' · metadata:' || key || coalesce(chr(10) || repeat(' ', 11) || 'evidence: ' || evidence, '')"
_TOTALS = " || ".join(f"'  ' || {s} || ' {s}'" for s in report.COUNTS)
_add(
    "report_human",
    lambda s, d: _reports(s, d).select("path", report.as_text().alias("text")),
    f"""{_WITH_DOCUMENTS}, {_SUMMED}, l AS (SELECT path, string_agg({_LINES}, chr(10) ORDER BY spot) AS body FROM w GROUP BY path)
    SELECT CAST(doc_id AS VARCHAR) AS path, chr(10) || 'argil v{__version__}  —  ' || doc_id || chr(10) || '  format: unknown   size: ' || {oracle.human_bytes('CAST(strlen(text) AS BIGINT)')} || '   risk score: ' || coalesce(risk_score, 0) || '/100' || chr(10) || chr(10)
    || CASE WHEN body IS NULL THEN '  ✓ no findings' || chr(10) ELSE body || chr(10) || chr(10) || {_TOTALS} || chr(10) END AS text FROM documents LEFT JOIN g ON g.path = CAST(doc_id AS VARCHAR) LEFT JOIN l ON l.path = CAST(doc_id AS VARCHAR)""",
)
