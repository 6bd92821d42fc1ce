"""Library entry points: scan a folder, a table of binary contents, or a table of text."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argil.operators import entropy, metadata, pickles, pii, report, secrets
from argil.operators.findings import gate, union
from argil.sources import files
from argil.sources.shared import cut


@dataclass(frozen=True)
class Frames:
    """The tables that scanners read. The first four come from one pass over the files, made when the scan began; ``chunks`` (raw bytes)
    and ``pieces`` (bytes of pickle streams) are lazy and read the files again, for scanners that want bytes."""

    artifacts: DataFrame
    metadata_kv: DataFrame
    pickle_streams: DataFrame
    raw_hits: DataFrame
    chunks: DataFrame
    pieces: DataFrame


Scanner = Callable[[Frames], DataFrame]

#: By name, in the order in which findings are emitted. A scanner of your own takes ``Frames`` and returns findings.
SCANNERS: dict[str, Scanner] = {
    "pickle": lambda f: pickles.scan(f.pickle_streams),
    "secrets": lambda f: secrets.scan(f.raw_hits),
    "pii": lambda f: pii.scan(f.metadata_kv),
    "metadata": lambda f: metadata.scan(f.artifacts, f.metadata_kv),
    "entropy": lambda f: entropy.scan(f.pickle_streams),
}


@dataclass(frozen=True)
class Scan:
    """Outcome of a scan; its tables are lazy, but none of them reads a file again."""

    artifacts: DataFrame
    findings: DataFrame
    errors: DataFrame

    def reports(self, min_severity: str = "info") -> DataFrame:
        return report.reports(self.artifacts, self.findings, min_severity)

    def gate(self, fail_on: str = "high", min_severity: str = "info") -> DataFrame:
        from argil.operators.findings import at_least

        return gate(at_least(self.findings, min_severity), fail_on)


def frames(decoded: DataFrame, chunks: DataFrame, pieces: DataFrame) -> Frames:
    return Frames(files.artifacts(decoded), files.metadata_kv(decoded), files.pickle_streams(decoded), files.raw_hits(decoded), chunks, pieces)


def _run(decoded: DataFrame, chunks: DataFrame, pieces: DataFrame, scanners: Mapping[str, Scanner] | None) -> Scan:
    once = cut(decoded)
    own = frames(once, chunks, pieces)
    chosen = SCANNERS if scanners is None else scanners
    return Scan(own.artifacts, union([s(own) for s in chosen.values()]), files.errors(once))


def scan(spark: SparkSession, path: str, recursive: bool = False, scanners: Mapping[str, Scanner] | None = None) -> Scan:
    """Scan a file or the model files of a folder that all executors can open. Each file is decoded once, whatever the scanners, and
    what was found is checkpointed; the scanners themselves are lazy."""
    raw = scanners is None or "secrets" in scanners
    return _run(files.decoded(spark, path, recursive, raw), files.chunks(spark, path, recursive), files.stream_pieces(spark, path, recursive), scanners)


def scan_binary(contents: DataFrame, scanners: Mapping[str, Scanner] | None = None, decoded: DataFrame | None = None) -> Scan:
    """Scan a table with ``path`` and ``content``, as the binary source reads it from any file system. ``decoded`` is what
    ``files.decoding`` gives for it, where the contents were decoded as they were made."""
    raw = scanners is None or "secrets" in scanners
    return _run(files.from_binary(contents, raw) if decoded is None else decoded, files.chunks_of(contents), files.pieces_of(contents), scanners)


def text_as_metadata(table: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A text table in the shape of metadata: one pair per row, its key the name of the column."""
    return table.select(F.col(id_column).cast("string").alias("path"), F.lit(0).alias("ord"), F.lit(text_column).alias("key"), F.col(text_column).alias("value"))


def scan_text(kv: DataFrame) -> DataFrame:
    """Findings of a metadata table without files: personal data, credentials and fingerprints of infrastructure."""
    return union([secrets.scan_text(kv), pii.scan(kv), metadata.scan_values(kv)])
