"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a relation that may be broadcast; beyond them a shuffle join runs.
BROADCAST_BYTES = 4 << 20
#: Bytes of an Arrow batch of texts.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    """Sum of an array of longs; 0 if it is empty."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which every executor shares.

    Only where the setting is absent (tests, a laptop) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeleaf-"))
            base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lodeleaf-{uuid.uuid4().hex}"


def stored(df: DataFrame, *folders: str) -> DataFrame:
    """df written once to the shared folder and read back: a cut in the lineage that survives lost executors. folders: columns to partition it by."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str, *folders: str) -> DataFrame:
    """As stored, but as an external table in buckets of a key, under a name of its own: joins of such tables by the key move none of their rows."""
    name = f"lodeleaf_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", shared_dir(df.sparkSession)).partitionBy(*folders).bucketBy(buckets, key).saveAsTable(name)
    return df.sparkSession.table(name)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes; 10,000 whole texts may be large. A session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ARROW_BYTES)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory."""

    def width(kind: T.DataType, value: Column) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType):
                return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + width(inner, x)), F.lit(0)) + 16
            return F.coalesce(F.size(value), F.lit(0)) * 8 * len(inner.fields if isinstance(inner, T.StructType) else [0]) + 16
        if isinstance(kind, T.StructType):
            return sum((width(f.dataType, value[f.name]) for f in kind.fields), F.lit(0))
        return F.lit(8)

    return sum((width(f.dataType, F.col(f.name)) for f in df.schema.fields), F.lit(16)).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most ``limit`` bytes, else unchanged (a shuffle join follows).

    df is counted once more, so it should be stored or cheap.
    """
    took = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if took <= limit else df
