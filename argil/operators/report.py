"""Reports: summary, score and order per artifact, and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil import __version__
from argil.functions import dims
from argil.functions import expressions as X

TOOL = "argil"
COUNTS = tuple(reversed(dims.SEVERITIES))
_EXACT = "decimal(4,2)"


def scores(findings: DataFrame) -> DataFrame:
    """``path``, counts by severity, exact ``raw`` risk, ``risk_score`` and ``worst`` of every path that has findings.

    Confidences are added up as decimals, so that the score doesn't depend on the order of tasks.
    """
    weighted = X.sev_weight(F.col("severity")).cast("decimal(4,0)") * F.col("confidence").cast(_EXACT)
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in COUNTS]
    summed = findings.groupBy("path").agg(*counts, F.sum(weighted).alias("raw"), F.max("sev_ord").cast("int").alias("worst"))
    return summed.withColumn("risk_score", X.risk(F.col("raw")))


def reports(artifacts: DataFrame, findings: DataFrame, min_severity: str = "info") -> DataFrame:
    """One row per artifact: ``path, format, size, risk_score``, counts, ``worst``, and ``findings`` as an array in report order.

    Score and counts are over all findings; only the array, and ``worst``, are of ``min_severity`` and above. One shuffle by path;
    an artifact's findings meet in one task, as its report is one document.
    """
    least = dims.SEVERITIES.index(min_severity)
    weighted = X.sev_weight(F.col("severity")).cast("decimal(4,0)") * F.col("confidence").cast(_EXACT)
    entry = F.struct((-F.col("sev_ord")).alias("a"), (-F.col("confidence")).alias("b"), "seq", *[c for c in findings.columns if c not in ("path", "seq")])
    kept = F.col("sev_ord") >= least
    summed = findings.groupBy("path").agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in COUNTS),
        F.sum(weighted).alias("raw"),
        F.max(F.when(kept, F.col("sev_ord"))).cast("int").alias("worst"),
        F.collect_list(F.when(kept, entry)).alias("found"),
    )
    joined = artifacts.select("path", "format", "size").join(summed, "path", "left")
    zero = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in COUNTS]
    found = F.transform(F.array_sort(F.coalesce("found", F.array().cast(summed.schema["found"].dataType))), lambda f: f.dropFields("a", "b", "seq"))
    return joined.select("path", "format", "size", X.risk(F.col("raw")).alias("risk_score"), *zero, "worst", found.alias("findings"))


def _json_finding(f: Column) -> Column:
    return F.struct(f.rule_id.alias("rule_id"), f.scanner.alias("scanner"), f.severity.alias("severity"), f.confidence.alias("confidence"), f.title.alias("title"), f.detail.alias("detail"), f.location.alias("location"), f.references.alias("references"), f.remediation.alias("remediation"), f.evidence.alias("evidence"))


def as_json(pretty: bool = True) -> Column:
    """A report as JSON; absent parts are left out."""
    report = F.struct(
        F.lit(TOOL).alias("tool"),
        F.lit(__version__).alias("tool_version"),
        F.col("path").alias("target"),
        "format",
        F.col("size").alias("bytes"),
        "risk_score",
        F.struct(*COUNTS).alias("summary"),
        F.transform("findings", _json_finding).alias("findings"),
    )
    return F.to_json(report, {"pretty": "true"} if pretty else {})


def sarif_run() -> Column:
    """One SARIF run: the results of an artifact."""

    def result(f: Column) -> Column:
        place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.array(F.struct(f.location.component.alias("name"))).alias("logicalLocations")).alias("physicalLocation"))
        references = F.coalesce(f.references, F.array().cast("array<string>"))
        properties = F.struct(f.scanner.alias("scanner"), f.confidence.alias("confidence"), f.severity.alias("severity"), references.alias("references"))
        text = F.struct(F.concat(f.title, F.lit(": "), f.detail).alias("text"))
        return F.struct(f.rule_id.alias("ruleId"), X.sarif_level(f.severity).alias("level"), text.alias("message"), properties.alias("properties"), F.array(place).alias("locations"))

    rules = F.array().cast("array<string>")
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(__version__).alias("version"), rules.alias("rules"))
    return F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("findings", result).alias("results"))


def as_sarif(pretty: bool = True) -> Column:
    """A report as a SARIF 2.1.0 log with one run."""
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(sarif_run()).alias("runs"))
    return F.to_json(log, {"pretty": "true"} if pretty else {})


#: ANSI codes of severities, of score bands and of parts.
_COLOURS = {"critical": "\x1b[1;31m", "high": "\x1b[35m", "medium": "\x1b[33m", "low": "\x1b[34m", "info": "\x1b[2m", "green": "\x1b[32m", "yellow": "\x1b[33m", "red": "\x1b[31m", "bold": "\x1b[1m", "dim": "\x1b[2m", "reset": "\x1b[0m"}


def as_text(colour: bool = False) -> Column:
    """A report for people: a banner, two or three lines a finding, and the counts."""
    code = {k: v if colour else "" for k, v in _COLOURS.items()}
    reset = F.lit(code["reset"])

    def painted(name: str, *parts: Column) -> Column:
        return F.concat(F.lit(code[name]), *parts, reset)

    def by(value: Column, names: tuple[str, ...]) -> Column:
        out = F.lit("")
        for n in names:
            out = F.when(value == n, F.lit(code[n])).otherwise(out)
        return out

    pad = F.lit(" " * 11)

    def lines(f: Column) -> Column:
        percent = F.concat(F.format_string("%.0f", f.confidence * 100), F.lit("% conf)"))
        head = F.concat(F.lit("  "), by(f.severity, dims.SEVERITIES), F.lpad(F.upper(f.severity), 8, " "), reset, F.lit("  "), f.title, F.lit("  "), painted("dim", F.lit("("), percent))
        where = F.concat(pad, painted("dim", f.rule_id, F.lit(" · "), f.scanner, F.lit(" · "), f.location.component))
        return F.concat_ws("\n", head, where, F.concat(pad, painted("dim", F.lit("evidence: "), f.evidence)))

    score = F.col("risk_score")
    banner = F.concat(F.lit("\n"), painted("bold", F.lit(TOOL)), F.lit(f" v{__version__}  —  "), "path", F.lit("\n  format: "), "format", F.lit("   size: "), X.human_bytes(F.col("size")), F.lit("   risk score: "), by(X.score_band(score), ("green", "yellow", "red")), score.cast("string"), F.lit("/100"), reset, F.lit("\n\n"))
    counts = F.concat(*(x for i, s in enumerate(COUNTS) for x in (F.lit("  "), F.lit(code[s]), F.col(s).cast("string"), F.lit(f" {s}"))), reset)
    body = F.concat(F.array_join(F.transform("findings", lines), "\n"), F.lit("\n\n"), counts, F.lit("\n"))
    return F.concat(banner, F.when(F.size("findings") == 0, F.concat(F.lit("  "), painted("green", F.lit("✓ no findings")), F.lit("\n"))).otherwise(body))
