"""What is stored: lists, details, deletions, folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.functions.paths import ancestors, basename, dirname
from lodeleaf.functions.text import normalised
from lodeleaf.operators.context import joined

#: Characters of a document's content in one row.
CONTENT_CHARS = 1 << 20


def documents(chunks: DataFrame, folder: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """One row for each source: name, folder, chunks and the first chunk's hash, time and size (0 as null).

    folder: part of the folder's path; text: to be found in a chunk, whatever case and accents; limit: after sorting by path.
    """
    first = F.struct("chunk_index", *(c for c in ("source_hash", "source_mtime", "source_size") if c in chunks.columns))
    found = F.bool_or(F.contains(normalised(F.col("text")), normalised(F.lit(text)))) if text else F.lit(True)
    out = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min_by(first, F.struct("chunk_index", "source_hash")).alias("first"), found.alias("found"))
    out = out.filter("found").select("source", basename(F.col("source")).alias("name"), dirname(F.col("source")).alias("folder"), "chunks", *(F.nullif(f"first.{c}", F.lit(0)).alias(c) if c != "source_hash" else F.col("first.source_hash") for c in ("source_hash", "source_mtime", "source_size") if c in chunks.columns))
    if folder:
        out = out.filter(F.contains("folder", F.lit(folder.replace("\\", "/"))))
    return out if limit is None else out.orderBy(F.lower("source"), "source").limit(limit)


def details(chunks: DataFrame, only: Column | None = None, most: int = CONTENT_CHARS) -> DataFrame:
    """source, part, chunks and the text of the part's chunks in order.

    A source is one document. A part ends with the chunk that fills ``most`` characters, so that a row is bounded by that and one chunk.
    """
    rows = chunks if only is None else chunks.filter(only)
    before = Window.partitionBy("source").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.floor(F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / most))
    return rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("chunks"), joined(["chunk_index", "chunk_id"], F.col("text"), "\n\n").alias("content"))


def matches_path(source: Column, patterns: tuple[str, ...]) -> Column:
    """Any of the parts occurs in the path, whatever case and kind of slash."""
    low = F.replace(F.lower(source), F.lit("\\"), F.lit("/"))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p.lower().replace("\\", "/"))) for p in patterns), F.lit(False))


def without(chunks: DataFrame, gone: Column) -> DataFrame:
    """chunks but those of sources where gone holds; a null is kept."""
    return chunks.filter(~F.coalesce(gone, F.lit(False)))


def folders(paths: DataFrame) -> DataFrame:
    """paths(source) to every folder once: path, parent (null at the top), name, depth."""
    all_ = paths.select(F.explode(ancestors(F.col("source"))).alias("path")).distinct()
    return all_.select("path", F.nullif(dirname(F.col("path")), F.lit("")).alias("parent"), basename(F.col("path")).alias("name"), F.size(F.split("path", "/")).alias("depth"))
