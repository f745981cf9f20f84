"""A folder kept in step with a store, once or again and again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeleaf.operators.sync import indexed, plan, visible
from lodeleaf.sources.files import fingerprints, folder
from lodeleaf.sources.scratch import stored
from lodeleaf.sources.store import ChunkStore


def keyed(files: DataFrame) -> DataFrame:
    return files.withColumn("source", F.regexp_replace("path", "^[a-z]+:/*", "/")).withColumn("source_hash", F.sha1("content"))


def synchronise(spark: SparkSession, root: str, store: ChunkStore, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the store in step with the folder; returns the plan(source, state) that was carried out.

    read makes chunks of files(path, ..., content, source, source_hash). New and changed files are read, the chunks of
    changed, vanished and hidden ones go; parts of the store that no such file lies in are not touched.
    """
    shown, hidden = visible(folder(spark, root))
    index = indexed(store.read()) if store.exists() else fingerprints(shown).limit(0)
    steps = stored(plan(fingerprints(shown), index, keyed(hidden).select("source")))
    pending = steps.filter(F.col("state").isin("nuevo", "modificado")).select("source")
    gone = steps.filter("state <> 'nuevo'").select("source")
    new = None if pending.isEmpty() else stored(read(keyed(shown).join(pending, "source", "left_semi")))
    store.replace(gone, new)
    return steps


def watch(spark: SparkSession, root: str, store: ChunkStore, read: Callable[[DataFrame], DataFrame], checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """synchronise() at every trigger. Spark's file stream knows a file by its path and never sees it changed or gone; a clock sees both."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda *_: synchronise(spark, root, store, read) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
