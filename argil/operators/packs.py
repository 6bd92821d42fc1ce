"""Evaluation of rule packs: facts per artifact, then conditions over them."""

from __future__ import annotations

import pickletools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil.api import Frames
from argil.functions import dims
from argil.functions import expressions as X
from argil.functions.rules import PackRule, imports_of, opcodes_of
from argil.operators import pickles, secrets
from argil.operators.findings import constants, finding, union

_NAMES = {ord(op.code): op.name for op in pickletools.opcodes}


def opcodes(examined: DataFrame) -> DataFrame:
    """``(path, opcode)``: names of the opcodes that a stream has before it breaks off, each once per stream."""
    names = F.create_map(*(x for k, v in _NAMES.items() for x in (F.lit(k), F.lit(v))))
    return examined.filter("last").select("path", F.explode("opcodes").alias("code")).select("path", names[F.col("code")].alias("opcode"))


def _import_matches(pattern: str) -> Column:
    """``module.*`` covers a module and all below it; another pattern is a full name."""
    if pattern.endswith(".*"):
        return (F.col("module") == pattern[:-2]) | F.col("module").startswith(pattern[:-1])
    return F.concat_ws(".", "module", "name") == pattern


def facts(frames: Frames, rules: Sequence[PackRule]) -> DataFrame:
    """``(path, fact)`` of all that holds; a fact may come more than once."""
    parts = [frames.artifacts.select("path", F.lit(None).cast("string").alias("fact"))]

    def named(labels: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, labels)), F.col("rule") + 1)

    for target in ("metadata", "raw"):
        chosen = [(f"string:{i}:{v}", dims.Rule(r.rule_id, v, r.severity, r.confidence, p, 1)) for i, r in enumerate(rules) if target in r.targets for v, p in r.strings.items()]
        if chosen:
            hits = secrets.text_hits(frames.metadata_kv, [r for _, r in chosen]) if target == "metadata" else secrets.raw_hits(frames.chunks, [r for _, r in chosen])
            parts.append(hits.select("path", named([f for f, _ in chosen]).alias("fact")))
    if wanted := imports_of(rules):
        found = F.array_compact(F.array(*(F.when(_import_matches(p), F.lit(f"import:{p}")) for p in wanted)))
        parts.append(pickles.imports(frames.pickle_streams).select("path", F.explode(found).alias("fact")))
    if wanted := opcodes_of(rules):
        parts.append(opcodes(frames.pickle_streams).filter(F.col("opcode").isin(*wanted)).select("path", F.concat(F.lit("opcode:"), "opcode").alias("fact")))
    return union(parts)


def scan(frames: Frames, rules: Sequence[PackRule]) -> DataFrame:
    """A finding for each artifact and rule whose condition holds. One shuffle, of distinct facts, whatever the number of rules."""
    known = facts(frames, rules).groupBy("path").agg(F.collect_set("fact").alias("known"))

    def of(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("rule") + 1)

    hits = F.array_compact(F.array(*(F.when(r.condition.column(i, F.col("known")), F.lit(i)) for i, r in enumerate(rules))))
    held = known.select("path", F.explode(hits).alias("rule"))
    references = of([constants(r.references).cast("array<string>") for r in rules])
    place = F.lit(len(dims.SCANNERS) << 58) + F.col("rule").cast("long")
    return held.select(
        *finding("rules", F.col("path"), place, of([F.lit(r.rule_id) for r in rules]), of([F.lit(r.severity) for r in rules]), of([F.lit(r.confidence) for r in rules]), of([F.lit(r.name) for r in rules]), F.lit("The condition of a rule pack holds for this artifact."), F.lit("artifact"), None, references, of([F.lit(r.remediation) for r in rules]))
    )


def scanner(rules: Sequence[PackRule]):  # noqa: ANN201 - an api.Scanner
    """A scanner for ``api.scan(scanners=...)``."""
    return lambda frames: scan(frames, rules)


def text_scan(kv: DataFrame, rules: Sequence[PackRule]) -> DataFrame:
    """Paths and ids of rules that hold for a metadata table without files; imports and opcodes hold for none."""
    strings = [(i, v, p) for i, r in enumerate(rules) if "metadata" in r.targets for v, p in r.strings.items()]
    found = F.array_compact(F.array(F.lit(""), *(F.when(F.size(X.matches(F.col("value"), p)) > 0, F.lit(f"string:{i}:{v}")) for i, v, p in strings)))
    known = kv.select("path", F.explode(found).alias("fact")).groupBy("path").agg(F.collect_set("fact").alias("known"))
    hits = F.array_compact(F.array(*(F.when(r.condition.column(i, F.col("known")), F.lit(r.rule_id)) for i, r in enumerate(rules))))
    return known.select("path", F.explode(hits).alias("rule_id"))
