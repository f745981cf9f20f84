"""Incremental synchronisation of a chunk table with a folder, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, ...) to (visible, hidden): a file is hidden by a sibling of its name with .hidden; markers are neither."""
    marked = files.filter(F.col("path").endswith(".hidden")).select(F.regexp_replace("path", r"\.hidden$", "").alias("path")).distinct()
    own = files.filter(~F.col("path").endswith(".hidden"))
    return own.join(marked, "path", "left_anti"), own.join(marked, "path", "left_semi")


def indexed(chunks: DataFrame) -> DataFrame:
    """source, source_hash and number of chunks of what is stored."""
    return chunks.groupBy("source").agg(F.min("source_hash").alias("source_hash"), F.count(F.lit(1)).alias("chunks"))


def plan(disk: DataFrame, index: DataFrame, hidden: DataFrame) -> DataFrame:
    """disk and index (source, source_hash), hidden (source) to source, state: nuevo, modificado, eliminado, oculto.

    A hidden source that is indexed is listed twice: it goes, and it is hidden.
    """
    d, i = disk.select("source", F.col("source_hash").alias("dh")), index.select("source", F.col("source_hash").alias("ih"), F.lit(True).alias("known"))
    both = d.withColumn("there", F.lit(True)).join(i, "source", "full_outer")
    state = F.when(F.col("known").isNull(), "nuevo").when(F.col("there").isNull(), "eliminado").when(~F.col("dh").eqNullSafe(F.col("ih")), "modificado")
    changed = both.withColumn("state", state).filter("state is not null").select("source", "state")
    return changed.unionByName(hidden.select("source", F.lit("oculto").alias("state")))


def applied(chunks: DataFrame, steps: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The chunk table after a plan: chunks of changed and gone sources out, new ones in, in one pass."""
    gone = steps.filter(F.col("state").isin("modificado", "eliminado", "oculto")).select("source").distinct()
    return chunks.join(gone, "source", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def notice(steps: DataFrame, most: int = 1000) -> DataFrame:
    """JSON payloads with what was processed and removed, of about ``most`` sources each; no row if nothing changed."""
    name = F.element_at(F.split("source", "/"), -1)
    item = F.struct(name.alias("nombre"), F.col("source").alias("ruta"))
    of = lambda *states: F.array_sort(F.collect_list(F.when(F.col("state").isin(*states), item)))
    block = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-steps.count() // most))))
    lists = steps.groupBy(block).agg(of("nuevo", "modificado").alias("procesados"), of("eliminado").alias("eliminados"))
    return lists.filter("size(procesados) + size(eliminados) > 0").select(F.to_json(F.struct("procesados", "eliminados")).alias("payload"))
