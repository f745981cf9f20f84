"""Stopwords and their misspellings in many texts, by an equi-join with deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeleaf.functions.keywords import one_edit_apart
from lodeleaf.functions.text import compound_codes, normalised, words

#: Words of fewer letters are no misspellings.
SHORTEST = 4


def neighbourhood(word: Column) -> Column:
    """The word and what is left of it without one of its letters. Words that are one edit or swap apart have one of these in common."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, less).otherwise(F.array().cast("array<string>"))))


def misspelled(found: DataFrame, stopwords: DataFrame) -> DataFrame:
    """found(word) and stopwords(word) to the distinct words of found that are at most one edit, or swap of neighbours, from a stopword.

    Either side's words meet on their neighbourhoods and are compared then; no word meets the whole list.
    """
    own = found.select("word").distinct().filter(F.length("word") >= SHORTEST).select("word", F.explode(neighbourhood(F.col("word"))).alias("part"))
    stop = stopwords.select(F.col("word").alias("stop")).distinct().select("stop", F.explode(neighbourhood(F.col("stop"))).alias("part"))
    return own.join(stop, "part").filter(one_edit_apart(F.col("word"), F.col("stop"))).select("word").distinct()


def stopped(rows: DataFrame, text: str, stopwords: DataFrame) -> DataFrame:
    """rows with stop_exact and stop_near: the words and codes of the text that are stopwords, and those that are misspelled ones. Equal texts are looked up once."""
    norm = normalised(F.col(text))
    own = rows.filter(F.col(text).isNotNull()).select(F.md5(text).alias("__key"), F.explode(F.array_distinct(F.concat(words(norm), F.transform(compound_codes(norm), F.lower)))).alias("word")).distinct()
    listed = stopwords.select("word").distinct()
    near = misspelled(own, listed).withColumn("near", F.lit(True))
    met = own.join(listed.withColumn("exact", F.lit(True)), "word", "left").join(near, "word", "left").filter("exact or near")
    none = F.array().cast("array<string>")
    sets = met.groupBy("__key").agg(F.collect_set(F.when(F.col("exact"), F.col("word"))).alias("stop_exact"), F.collect_set(F.when(F.col("near"), F.col("word"))).alias("stop_near"))
    return rows.withColumn("__key", F.md5(text)).join(sets, "__key", "left").drop("__key").withColumns({c: F.coalesce(c, none) for c in ("stop_exact", "stop_near")})
