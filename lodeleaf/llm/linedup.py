"""Boilerplate lines by distinct-site spread.

A line is boilerplate if it stands on MIN_SITES distinct sites (sources) and
in as many distinct texts; copies of one document alone don't make its lines
boilerplate. Lines that occur often enough get two HyperLogLog sketches, of
sites and of texts, that merge by aggregation. Estimates near the threshold
are replaced by exact distinct counts. Of each boilerplate line the first
occurrence in the smallest doc_id stays; all others go.

Edge cases: a null text stays null, an empty one empty; lines of fewer than
MIN_WORDS words stay; a null source is one site; rows of one doc_id are edited
alike; ties of equal doc_id keep the line in each; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.llm.common import WORD, small, stored, table

MIN_SITES = 8
MIN_WORDS = 3
#: Sketch size (log2 of buckets) and the band of estimates, as parts of the threshold, that are counted exactly.
LG_K = 12
BAND = (0.8, 1.25)


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def eligible(line: Column) -> Column:
    return line.rlike(rf"({WORD}[\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}{WORD}")


def instances(docs: DataFrame) -> DataFrame:
    """One narrow row for each eligible line: doc_id, site, body (hash of the text), line."""
    site = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    lines = F.transform(F.filter(F.split("text", "\n"), eligible), line_key)
    return docs.filter(F.col("text").isNotNull()).select("doc_id", site.alias("site"), F.xxhash64("text").alias("body"), F.explode(lines).alias("line"))


def boilerplate(rows: DataFrame) -> DataFrame:
    """instances() to (line, first): the boilerplate lines and the document that keeps them."""
    often = stored(rows.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SITES).select("line"))
    held = stored(rows.join(small(often), "line", "left_semi"))
    sketched = held.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.hll_sketch_estimate(F.hll_sketch_agg("body", LG_K)).alias("bodies"), F.min("doc_id").alias("first")
    )
    sketched = stored(sketched.withColumn("least", F.least("sites", "bodies")))
    low, high = (b * MIN_SITES for b in BAND)
    near = sketched.filter(F.col("least").between(low, high)).select("line", "first")
    close = held.join(small(near.select("line")), "line", "left_semi")
    exact = close.select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("s"))
    exact = exact.join(close.select("line", "body").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("b")), "line")
    sure = sketched.filter(F.col("least") > high).select("line", "first")
    return sure.unionByName(near.join(exact.filter((F.col("s") >= MIN_SITES) & (F.col("b") >= MIN_SITES)).select("line"), "line"))


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """docs with text and n_chars edited, and the columns __lines and __removed.

    Edits meet their texts by a shuffle join at every size: they are as many as documents with boilerplate.
    """
    rows = instances(docs)
    found = stored(boilerplate(rows))
    own = rows.join(small(found), "line").select("doc_id", F.struct("line", F.col("doc_id").eqNullSafe(F.col("first")).alias("keep")).alias("e"))
    edits = stored(own.groupBy("doc_id").agg(F.collect_set("e").alias("__edits")).withColumnRenamed("doc_id", "__id"))
    joined = docs.join(edits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split("text", "\n")
    keys = F.transform(lines, line_key)
    gone = F.transform(F.filter("__edits", lambda e: ~e["keep"]), lambda e: e["line"])
    once = F.transform(F.filter("__edits", lambda e: e["keep"]), lambda e: e["line"])

    def stays(x: Column, i: Column) -> Column:
        k = F.get("__keys", i)
        return ~F.array_contains("__gone", k) & (~F.array_contains("__once", k) | (F.array_position("__keys", k) == i + 1))

    edited = joined.withColumn("__keys", F.when(F.col("__edits").isNotNull(), keys)).withColumn("__gone", gone).withColumn("__once", once)
    kept = F.when(F.col("__edits").isNotNull(), F.filter(lines, stays))
    edited = edited.withColumn("__kept", kept)
    text = F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text"))
    count = F.coalesce(F.size(lines), F.lit(0))
    edited = edited.withColumn("__lines", F.when(F.col("text").isNull(), 0).otherwise(count)).withColumn("__removed", F.when(F.col("__kept").isNotNull(), count - F.size("__kept")).otherwise(F.lit(0)))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length(text)).otherwise(F.col("n_chars")))
    return edited.withColumn("text", text).select(*docs.columns, "__lines", "__removed")


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return without_boilerplate(docs).select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), "text")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without boilerplate lines; documents of which no word is left go."""
    out = without_boilerplate(docs)
    # One struct a row: a filter on edited texts would else be pushed below the edits and run them again.
    rows = out.select(F.explode(F.array(F.struct(*docs.columns, "__removed"))).alias("__row")).select("__row.*")
    return rows.filter((F.col("__removed") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)
