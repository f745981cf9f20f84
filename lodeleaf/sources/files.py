"""Folders of documents: listing, fingerprints, Markdown and image bytes."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeleaf.functions.paths import basename, extension, source_key

EXTENSIONS = (".pdf", ".html", ".md")
SKIPPED = (".svn", ".git", "__pycache__")
LEAST_IMAGE_BYTES = 2048


def listed(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """files(path, ...) of the given kinds (and their .hidden markers), outside folders of tools."""
    path = F.regexp_replace("path", r"\.hidden$", "")
    return files.filter(extension(path).isin(*extensions) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED)))


def folder(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length and content of every document under a folder, read by Spark.

    Spark reads no rows of empty files; .hidden markers, which mostly are empty, come from its list of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    markers = [(unquote(f).replace("file:///", "file:/"),) for f in files.inputFiles() if f.endswith(".hidden")]
    empty = spark.createDataFrame(markers, "path string").select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return listed(files.filter(~F.col("path").endswith(".hidden")).unionByName(empty))


def fingerprints(files: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """source, source_hash, source_mtime (epoch seconds), source_size of files with content."""
    return files.select(source_key(F.regexp_replace("path", "^[a-z]+:/*", "/"), roots).alias("source"), F.sha1("content").alias("source_hash"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("source_mtime"), F.col("length").alias("source_size"))


def markdown_text(name: Column, content: Column) -> Column:
    """The file's name and its text."""
    return F.concat(basename(name), F.lit("\n\n"), content)


def data_uri(src: Column) -> Column:
    """Bytes of an image that stands in its own address; null for any other."""
    return F.when(src.rlike("(?i)^data:image/[^;,]+;base64,"), F.try_to_binary(F.regexp_replace(src, "(?i)^data:[^,]*,", ""), F.lit("base64")))


def image_cache_key(url: Column) -> Column:
    """Name of a remote image in a cache: digest of the address, and its ending if that is short."""
    ending = extension(F.regexp_replace(url, "[?#].*$", ""))
    return F.concat(F.sha2(url, 256), F.when(F.length(ending) <= 6, ending).otherwise(""))


def image_admitted(size: Column, width: Column, height: Column) -> Column:
    """Large enough in bytes and, where width or height are numbers, in pixels."""
    pixels = lambda c: F.regexp_replace(F.trim(c), "px$", "").try_cast("int")
    big = lambda c: F.coalesce((pixels(c) >= 100) | (pixels(c) <= 0), F.lit(True))
    return (size >= LEAST_IMAGE_BYTES) & big(width) & big(height)


def image_hash(content: Column) -> Column:
    """Digest of an image's bytes in base64. Spark's base64 has line breaks, which are taken out."""
    return F.sha1(F.translate(F.base64(content), "\r\n", ""))


def captions(images: DataFrame, captioner, cache: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """images(image_id, content) to image_id, caption: each distinct image is captioned once, those in cache(hash, caption) never.

    captioner: function from a DataFrame(hash, content) to one with caption added. seen: gets the images that the cache
    had (hits), the others (misses) and those left without a caption (none) when the result is used.
    """
    keyed = images.withColumn("hash", image_hash(F.col("content")))
    known = cache.select("hash", "caption") if cache is not None else keyed.select("hash", F.lit(None).cast("string").alias("caption")).limit(0)
    new = captioner(keyed.select("hash", "content").dropDuplicates(["hash"]).join(known, "hash", "left_anti")).select("hash", "caption")
    both = known.withColumn("cached", F.lit(True)).unionByName(new.withColumn("cached", F.lit(False)))
    out = keyed.select("image_id", "hash").join(both, "hash", "left")
    if seen is not None:
        hit = F.coalesce("cached", F.lit(False))
        out = out.observe(seen, F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(F.col("caption").isNull()).alias("none"))
    return out.select("image_id", "caption")
