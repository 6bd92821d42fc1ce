"""Bounded, deterministic samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_column: str) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text is divisible by ``FOLDS``. False for a null id, which no label
    can name, so that such a document is never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held_out")


def labelled(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of all rows to learn from: held-out rows, rows without an id or a label, and ids with contradicting labels
    are left out."""
    one = labels.filter(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_column).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    return one.filter("label = most").filter(~held_out("doc_id")).select("doc_id", F.col("label").cast("int").alias("label"))


def sample(labels: DataFrame, label: str, most: int, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of at most ``most`` rows of each class of ``labelled``, those whose ids hash lowest.

    The bound makes the result small enough to broadcast at any size of ``labels``.
    """
    free = labelled(labels, label, id_column).withColumn("h", F.xxhash64("doc_id"))
    parts = [free.filter(F.col("label") == y).orderBy("h", "doc_id").limit(most) for y in (0, 1)]
    return parts[0].union(parts[1]).select("doc_id", "label")
