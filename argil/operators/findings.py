"""Building blocks of findings, and what is done with all of them: union, order, filter, gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil.functions import dims
from argil.functions import expressions as X
from argil.functions.schema import FINDINGS


def seq(scanner: str, major: Column, minor: Column) -> Column:
    """Place of a finding in a report: scanner, then ``major`` (pair or stream, below 2**26), then ``minor`` (below 2**32)."""
    return (F.lit(dims.SCANNERS.index(scanner) << 58) + F.shiftleft(major.cast("long"), 32) + minor.cast("long")).alias("seq")


def finding(
    scanner: str,
    path: Column,
    place: Column,
    rule_id: Column,
    severity: Column,
    confidence: Column,
    title: Column,
    detail: Column,
    component: Column,
    offset: Column | None = None,
    references: Column | None = None,
    remediation: Column | None = None,
    evidence: Column | None = None,
) -> list[Column]:
    """Columns of a finding in their order. Confidence is clamped to 0..1; absent parts are null."""
    nothing = F.lit(None)
    values = [
        path, place, rule_id, F.lit(scanner), severity, X.sev_ord(severity), X.clamp(confidence.cast("double")), title, detail,
        F.struct(component.alias("component"), (nothing if offset is None else offset).cast("long").alias("offset")),
        *(nothing if x is None else x for x in (references, remediation, evidence)),
    ]
    return [v.cast(f.dataType).alias(f.name) for v, f in zip(values, FINDINGS)]


def constants(values: Sequence[str]) -> Column:
    """An array of references, null if there is none."""
    return F.array(*map(F.lit, values)) if values else F.lit(None)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(findings: DataFrame) -> DataFrame:
    """Worst first, then most certain, then as emitted. Range-partitioned, so that no task sees all. The ranges are sampled from shuffled
    findings, as a sample of the scanners' own output would run them twice."""
    return findings.repartition("path", "seq").orderBy("path", F.desc("sev_ord"), F.desc("confidence"), "seq")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("sev_ord") >= dims.SEVERITIES.index(severity))


def worst(findings: DataFrame) -> DataFrame:
    """One row: ordinal of the worst severity over all findings, 0 if there is none."""
    return findings.agg(F.coalesce(F.max("sev_ord"), F.lit(0)).cast("int").alias("worst"))


def gate(findings: DataFrame, fail_on: str = "high") -> DataFrame:
    """One row: exit code 1 if any finding is as severe as ``fail_on``, else 0. Without findings the worst is info."""
    return worst(findings).select(F.when(F.col("worst") >= dims.SEVERITIES.index(fail_on), 1).otherwise(0).alias("exit_code"), "worst")


def gates(findings: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: for each pair of a least severity shown and one to fail on, the exit code. One aggregation, whatever the pairs."""
    shown = [F.coalesce(F.max(F.when(F.col("sev_ord") >= dims.SEVERITIES.index(least), F.col("sev_ord"))), F.lit(0)) for least, _ in pairs]
    codes = [F.when(w >= dims.SEVERITIES.index(fail_on), 1).otherwise(0).alias("exit_code") for w, (_, fail_on) in zip(shown, pairs)]
    return findings.agg(F.array(*(F.struct(F.lit(least).alias("min_severity"), F.lit(fail_on).alias("fail_on"), c) for c, (least, fail_on) in zip(codes, pairs))).alias("gates"))


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that an earlier scan doesn't have: same artifact, rule, place and evidence count as the same. An equi anti-join."""
    key = ["path", "rule_id", "component", "offset", "evidence"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("component", F.col("location.component")).withColumn("offset", F.col("location.offset"))

    old = keyed(baseline).select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return keyed(findings).join(old, same, "left_anti").drop("component", "offset")
