"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Timestamps are UTC throughout; parsing and formatting must not drift.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Batches of whole texts: what a Python worker holds at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Large pages: a batch takes many times its markup as trees and parts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-changeable settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` where the cluster
    names one.  Only a local-mode session (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    named = tempfile.mkdtemp(prefix="hiretide-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives executor loss, and freezes columns
    (partition ids, sampled bounds) that a re-run could compute differently.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over four tasks a core, for steps that take long for the bytes they
    read: adaptive execution merges partitions by their bytes only."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
