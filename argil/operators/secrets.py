"""Credentials in raw bytes and in text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil.functions import dims
from argil.functions import expressions as X
from argil.operators.findings import finding, seq
from argil.operators.pii import numbered

_HITS = "path string, rule int, offset long, hit string"


def raw_hits(chunks: DataFrame, rules: Sequence[dims.Rule] = dims.SECRET_RULES) -> DataFrame:
    """All matches in chunks of raw bytes, each once: ``path, rule, offset, hit``. A chunk reports the matches that begin in its own
    span; one longer than the chunks' overlap may be cut short. For rule packs; the scanner's hits come with decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern.encode()) for r in rules]
        for batch in batches:
            out: list[tuple] = []
            for path, offset, begin, end, data in zip(*(batch.column(c) for c in ("path", "offset", "begin", "end", "bytes"))):
                view = data.as_buffer() if data.is_valid else b""
                base, low, high = offset.as_py(), begin.as_py(), end.as_py()
                for i, pattern in enumerate(patterns):
                    out += [(path.as_py(), i, base + m.start(), m[0].decode("latin-1")) for m in pattern.finditer(view) if low <= base + m.start() < high]
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["path", "rule", "offset", "hit"])

    return chunks.select("path", "offset", "begin", "end", "bytes").mapInArrow(run, _HITS)


def text_hits(kv: DataFrame, rules: Sequence[dims.Rule] = dims.SECRET_RULES) -> DataFrame:
    """All matches in metadata values: ``path, ord, key, rule, n, hit``. Built-in functions only."""
    parts = [F.transform(X.found(F.col("value"), r), numbered(i)) for i, r in enumerate(rules)]
    return kv.select("path", "ord", "key", F.explode(F.concat(*parts)).alias("h")).select("path", "ord", "key", "h.*")


def _of(rules: Sequence[dims.Rule], attribute: str) -> Column:
    return F.element_at(F.array(*(F.lit(getattr(r, attribute)) for r in rules)), F.col("rule") + 1)


def _findings(hits: DataFrame, rules: Sequence[dims.Rule], place: Column, component: Column, offset: Column | None) -> DataFrame:
    references = F.element_at(F.array(*(F.array(*map(F.lit, r.references)) for r in rules)), F.col("rule") + 1)
    name = _of(rules, "name")
    return hits.select(
        *finding("secrets", F.col("path"), place, _of(rules, "rule_id"), _of(rules, "severity"), _of(rules, "confidence"), F.concat(name, F.lit(" embedded in artifact")), F.concat(F.lit("The artifact holds what looks like a credential: "), name, F.lit(".")), component, offset, references, _of(rules, "remediation"), X.redact(F.col("hit")))
    )


def scan(hits: DataFrame, rules: Sequence[dims.Rule] = dims.SECRET_RULES) -> DataFrame:
    """Findings of ``hits(path, rule, offset, hit)`` in raw bytes, one for each rule and place, in the order of places."""
    place = F.lit(dims.SCANNERS.index("secrets") << 58) + F.least(F.col("offset"), F.lit((1 << 53) - 1)) * 32 + F.col("rule")
    return _findings(hits, rules, place, F.lit("raw"), F.col("offset"))


def scan_text(kv: DataFrame, rules: Sequence[dims.Rule] = dims.SECRET_RULES) -> DataFrame:
    """Findings in metadata values, for tables that have no raw bytes."""
    place = seq("secrets", F.col("ord"), F.shiftleft(F.col("rule"), 16) + F.col("n"))
    return _findings(text_hits(kv, rules), rules, place, F.concat(F.lit("metadata:"), "key"), None)
