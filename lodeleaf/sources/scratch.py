"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of texts.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes. A session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ARROW_BYTES)


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder serves where local tests set none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeleaf-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lodeleaf-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to a shared path and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
