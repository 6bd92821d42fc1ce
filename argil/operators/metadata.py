"""Build paths, infrastructure names and links in metadata, and the inventory of each artifact."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil.functions import dims
from argil.functions import expressions as X
from argil.operators.findings import constants, finding, seq
from argil.operators.pii import numbered

PATHS, CLOUD, LINKS = dims.METADATA_RULES
UNIX, WINDOWS = replace(PATHS, needs=dims.UNIX_NEEDS), replace(PATHS, pattern=dims.WINDOWS_PATH, needs=dims.WINDOWS_NEEDS)


def build_path(value: Column) -> Column:
    """The first Unix home path, else the first Windows one."""
    return F.coalesce(X.first_match(value, UNIX), X.first_match(value, WINDOWS))


def infrastructure(value: Column) -> Column:
    """The first infrastructure name; a text whose capitals hold nothing that one needs isn't searched."""
    needed = F.exists(F.array(F.upper(value)), lambda up: reduce(Column.__or__, (F.contains(up, F.lit(n)) for n in dims.CLOUD_NEEDS)))
    return F.when(needed, X.first_match(value, CLOUD))


def hits(value: Column) -> Column:
    """Array of ``struct(rule, n, hit)``: one path, one infrastructure name, and the first links."""

    def one(i: int, hit: Column) -> Column:
        return F.when(hit.isNotNull(), F.array(F.struct(F.lit(i).alias("rule"), F.lit(0).alias("n"), hit.alias("hit"))))

    links = F.transform(X.found(value, LINKS), numbered(2))
    parts = (one(0, build_path(value)), one(1, infrastructure(value)), links)
    return F.flatten(F.array_compact(F.array(*parts)))


def exploded(kv: DataFrame) -> DataFrame:
    return kv.select("path", "ord", "key", F.explode(hits(F.col("value"))).alias("h")).select("path", "ord", "key", "h.*")


DETAILS = ("a build path names an account or a host", "names a cloud service or an internal network", "holds a link, which may lead to private systems")


def scan_values(kv: DataFrame) -> DataFrame:
    """Findings of all values; the evidence is the match itself, not redacted."""
    rules = dims.METADATA_RULES

    def of(values: list) -> Column:
        return F.element_at(F.array(*values), F.col("rule") + 1)

    references = F.when(F.col("rule") == 0, constants(PATHS.references))
    return exploded(kv).select(
        *finding(
            "metadata",
            F.col("path"),
            seq("metadata", F.col("ord"), F.shiftleft(F.col("rule"), 16) + F.col("n")),
            of([F.lit(r.rule_id) for r in rules]),
            of([F.lit(r.severity) for r in rules]),
            of([F.lit(r.confidence) for r in rules]),
            of([F.lit(r.name) for r in rules]),
            F.concat(F.lit("Field `"), "key", F.lit("`: "), of([F.lit(d) for d in DETAILS]), F.lit(".")),
            F.concat(F.lit("metadata:"), "key"),
            references=references,
            evidence=F.col("hit"),
        )
    )


def counted(artifacts: DataFrame, kv: DataFrame) -> DataFrame:
    """Add ``n_kv``, where a decoder didn't count: one equi-join."""
    counts = kv.groupBy("path").agg(F.count("*").alias("n_kv"))
    return artifacts.select("path", "tensor_count").join(counts, "path", "left").withColumn("n_kv", F.coalesce("n_kv", F.lit(0)))


def inventory(artifacts: DataFrame) -> DataFrame:
    """``(path, n_kv, tensor_count)`` of the artifacts that have metadata or declare a number of tensors."""
    return artifacts.filter("n_kv > 0 OR tensor_count IS NOT NULL").select("path", "n_kv", "tensor_count")


def scan_inventory(artifacts: DataFrame) -> DataFrame:
    rule = dims.INVENTORY_RULE
    tensors = F.coalesce(F.col("tensor_count").cast("string"), F.lit("?"))
    detail = F.concat(F.lit("Parsed "), F.col("n_kv").cast("string"), F.lit(" metadata key(s); container declares "), tensors, F.lit(" tensor(s)."))
    place = seq("metadata", F.lit((1 << 26) - 1), F.lit(0))
    return inventory(artifacts).select(*finding("metadata", F.col("path"), place, F.lit(rule.rule_id), F.lit(rule.severity), F.lit(rule.confidence), F.lit(rule.name), detail, F.lit("header")))


def scan(artifacts: DataFrame, kv: DataFrame) -> DataFrame:
    return scan_values(kv).unionByName(scan_inventory(artifacts))
