"""Pickle streams: disassembly, classification of imports, and their findings."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from argil.functions import decode, dims
from argil.functions import expressions as X
from argil.functions.schema import STREAMS
from argil.operators.findings import constants, finding, seq

_REMEDIATION = "Don't load this file with pickle. Convert it to safetensors in isolation, or load it with weights_only=True."


def disassembled(streams: DataFrame) -> DataFrame:
    """What each stream of ``streams(path, ord, name, bytes)`` holds, see ``schema.STREAM``: a row, or several of one with very many
    imports. Sequential by nature, so one Arrow pass, no shuffle. A null is a stream without a byte."""
    arrow = to_arrow_schema(STREAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, name, data in zip(*(batch.column(c) for c in ("path", "ord", "name", "bytes"))):
                body = data.as_py() or b""
                for row in decode.examine(at.as_py(), name.as_py(), lambda body=body: io.BytesIO(body)):
                    row["imports"] = [{"module": m, "name": n, "offset": o} for m, n, o in row["imports"]]
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py()} | row], schema=arrow)

    return streams.select("path", F.col("ord").cast("int").alias("ord"), "name", "bytes").mapInArrow(run, STREAMS)


def imports(examined: DataFrame) -> DataFrame:
    """One row per import of examined streams: ``path, ord, component, n, module, name, offset, has_reduce``."""
    found = examined.select("path", "ord", F.col("name").alias("component"), "has_reduce", "first", F.posexplode("imports").alias("n", "i"))
    return found.select("path", "ord", "component", (F.col("first") + F.col("n")).alias("n"), "i.module", "i.name", "i.offset", "has_reduce")


def classified(found: DataFrame, rules: Sequence[tuple[str, str, str]] = dims.IMPORT_RULES) -> DataFrame:
    """Add ``severity`` and ``why`` of the first rule that an import matches (null if none), and ``benign``."""
    with_rule = found.withColumn("rule", X.classify_import(F.col("module"), F.col("name"), rules))
    return with_rule.select(*found.columns, "rule.severity", "rule.why", X.is_benign(F.col("module")).alias("benign"))


def unexpected(found: DataFrame) -> DataFrame:
    """Imports that are neither dangerous nor benign."""
    return classified(found).filter("severity IS NULL AND NOT benign").select(*found.columns)


def scan(examined: DataFrame, rules: Sequence[tuple[str, str, str]] = dims.IMPORT_RULES) -> DataFrame:
    """A finding for each examined stream that breaks off, each dangerous import and each unexpected one, occurrence by occurrence."""
    path, place = F.col("path"), F.col("ord")
    broken = examined.filter("truncated AND last").select(
        *finding("pickle", path, seq("pickle", place, F.lit(0)), F.lit("THK-PKL-090"), F.lit("medium"), F.lit(0.5), F.lit("Unparseable / truncated pickle stream"), F.concat(F.lit("Decoding broke off at byte "), F.col("stop_offset").cast("string"), F.lit("; what follows was not examined.")), F.col("name"), F.col("stop_offset"), constants((dims.LLM_OUTPUT,)))
    )
    full = F.concat_ws(".", "module", "name")
    dangerous = F.col("severity").isNotNull()
    judged = classified(imports(examined), rules).filter(dangerous | ~F.col("benign"))
    rows = judged.select(
        *finding(
            "pickle",
            path,
            seq("pickle", place, F.col("n") + 1),
            F.when(dangerous, "THK-PKL-001").otherwise("THK-PKL-002"),
            F.coalesce("severity", F.lit("low")),
            F.when(dangerous, F.when(F.col("has_reduce"), 0.97).otherwise(0.85)).otherwise(0.4),
            F.concat(F.when(dangerous, F.lit("Dangerous pickle import: ")).otherwise(F.lit("Unexpected pickle import: ")), full),
            F.when(dangerous, F.concat(F.lit("Loading this stream imports "), full, F.lit(", which "), "why", F.when(F.col("has_reduce"), F.lit("; the stream also calls what it imports.")).otherwise(F.lit(".")))).otherwise(F.concat(F.lit("Loading this stream imports "), full, F.lit(", which weights don't need."))),
            F.col("component"),
            F.col("offset"),
            F.when(dangerous, constants((dims.SUPPLY_CHAIN, dims.DESERIALIZATION, dims.LLM_SUPPLY))),
            F.when(dangerous, F.lit(_REMEDIATION)),
            F.when(dangerous, F.concat(F.lit("GLOBAL "), full)),
        )
    )
    return broken.unionByName(rows)
