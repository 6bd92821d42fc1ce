"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A session on one machine that names none gets a temporary one; a cluster must
    name it. What is written there goes with the session if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="argil-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
