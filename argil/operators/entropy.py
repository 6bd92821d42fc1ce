"""Shannon entropy of tumbling byte windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil.functions import dims
from argil.functions.decode import entropies
from argil.operators.findings import constants, finding, seq

_BATCH = 256


def windows_native(blobs: DataFrame, keys: list[str], window: int = dims.ENTROPY_WINDOW) -> DataFrame:
    """Entropy of each full window of ``blobs(keys..., bytes)``: ``keys..., off, entropy``. Built-in functions only; a row per
    distinct byte is shuffled after a partial count."""
    n = F.octet_length("bytes")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window, F.lit(window))).otherwise(F.array().cast("array<int>"))
    def piece(off: Column) -> Column:
        # one character a byte
        return F.struct(off.alias("off"), F.split(F.decode(F.substring(F.col("bytes"), off + 1, F.lit(window)), "ISO-8859-1"), "").alias("chars"))

    cut = blobs.select(*keys, F.explode(F.transform(starts, piece)).alias("w"))
    each = cut.select(*keys, F.col("w.off").alias("off"), F.explode("w.chars").alias("byte"))
    counts = each.groupBy(*keys, "off", "byte").agg(F.count("*").alias("c"))
    p = F.col("c") / window
    return counts.groupBy(*keys, "off").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def windows(blobs: DataFrame, keys: list[str], window: int = dims.ENTROPY_WINDOW, threshold: float | None = None) -> DataFrame:
    """The same by an Arrow kernel, without a shuffle. With a threshold only the first window of each row that reaches it."""
    schema = blobs.select(*keys).schema.add("off", "integer").add("entropy", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offs, values = [], [], []
            for i, blob in enumerate(batch.column(len(keys))):
                data = np.frombuffer(blob.as_buffer(), dtype=np.uint8) if blob.is_valid else np.zeros(0, np.uint8)
                n = len(data) // window
                full = data[: n * window].reshape(n, window)
                for at in range(0, n, _BATCH):
                    h = entropies(full[at : at + _BATCH], window)
                    keep = np.arange(len(h)) if threshold is None else np.flatnonzero(h >= threshold)[:1]
                    rows += [i] * len(keep)
                    offs += ((at + keep) * window).tolist()
                    values += h[keep].tolist()
                    if threshold is not None and len(keep):
                        break
            columns = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(offs, pa.int32()), pa.array(values, pa.float64())], names=schema.names)

    return blobs.select(*keys, "bytes").mapInArrow(run, schema)


def scan(examined: DataFrame, window: int = dims.ENTROPY_WINDOW) -> DataFrame:
    """One finding per examined pickle stream of which a full window reaches the threshold: the first such window."""
    found = examined.filter("last AND entropy IS NOT NULL")
    off = F.col("entropy_offset")
    detail = F.concat(F.lit(f"{window} bytes at offset "), off.cast("string"), F.lit(" have "), F.format_string("%.2f", F.col("entropy")), F.lit(" bits of entropy a byte, as compressed or encrypted data has."))
    return found.select(
        *finding("entropy", F.col("path"), seq("entropy", F.col("ord"), F.lit(0)), F.lit("THK-ENT-001"), F.lit("medium"), F.lit(0.5), F.lit("High-entropy region inside pickle stream"), detail, F.col("name"), off, constants((dims.SUPPLY_CHAIN,)))
    )
