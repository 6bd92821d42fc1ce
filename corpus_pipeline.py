"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark decontamination, mixing.

Each stage takes the documents that its predecessor kept and returns those that it keeps, with the same columns; the last adds how
many words of each document the mix takes, and drops the documents of which it takes none. Rows whose ``doc_id`` is null pass
every stage that needs an id to judge them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from argil.llm import decontamination, mixing, simhash_dedup, substring_dedup, toxicity
from argil.llm._text import read, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies share this much of their shingles of so many words. The settings of op10 are its query's only.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. The classifier learns from the labelled documents of the corpus."""
    model, by_lang = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, by_lang)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: by SimHash and Golay keys, verified, and by an exact join
    for copies that lie further apart."""
    return simhash_dedup.keep_one(docs, shingle=SHINGLE, similarity=SIMILARITY)


def strike_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has; a document of which nothing is left goes."""
    return substring_dedup.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size``, ``source_size``, ``target`` and ``taken`` in words."""
    return mixing.take(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", strike_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Toxicity and SimHash can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a stage's table when the next one is written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
