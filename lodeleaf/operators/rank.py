"""Strength, score and order of candidates, and the greedy removal of near duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.functions.text import token_set
from lodeleaf.sources.scratch import stored

# Weights of the score.
PATH, MATCH, DENSITY, QUALITY, PRIORITY, NO_PATH = 5000, 1000, 500, 1500, 6000, 2000

#: Candidates of a question that are compared in one round.
ROUND = 32
#: Ids of chunks that are numbered together are equal without this many low bits.
ID_BITS = 16


def required(n: Column) -> Column:
    """Matches that a strong candidate needs, from the number of keywords."""
    return F.when(n <= 1, 1).otherwise(2)


def is_strong(m: Column, p: Column, n: Column) -> Column:
    """m matches in the text, p in the path, n keywords."""
    return F.when(n == 0, True).when(m + p < required(n), False).when(p > 0, True).otherwise(m >= F.least(n, F.lit(3)))


def is_strong_legacy(m: Column, p: Column, n: Column) -> Column:
    return F.when(m + p < required(n), False).when(p > 0, True).otherwise(m >= F.greatest(required(n) + 1, n))


def admitted(m: Column, p: Column, n: Column) -> Column:
    """Admission of the wider search."""
    return (m + p >= required(n)) & ((p > 0) | (m >= F.least(n, F.lit(3))))


def admitted_after_answer(m: Column, p: Column, n: Column) -> Column:
    """Stricter admission in the retry after an answer without information."""
    return (m >= required(n)) & ((p > 0) | (m >= F.least(F.greatest(required(n) + 1, n), F.lit(3))))


def score(m: Column, p: Column, useful: Column, quality: Column, priority: Column, rank: Column) -> Column:
    base = PATH * p + MATCH * m + DENSITY * useful + QUALITY * quality + PRIORITY * priority - rank
    return base - F.when((p == 0) & (priority == 0), NO_PATH).otherwise(0)


def numbered(rows: DataFrame) -> DataFrame:
    """rows(qid, chunk_id, ...), each pair once, with rank: place of the chunk among its question's, by id, from 0.

    A question may have any number of rows: they are numbered within ranges of ids, behind the counts of earlier ranges.
    """
    rows = rows.withColumn("range", F.shiftright("chunk_id", ID_BITS))
    counts = rows.groupBy("qid", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("qid", "range", (F.sum("n").over(Window.partitionBy("qid").orderBy("range")) - F.col("n")).alias("before"))
    order = Window.partitionBy("qid", "range").orderBy("chunk_id")
    return rows.withColumn("rank", F.row_number().over(order) - 1).join(before, ["qid", "range"]).withColumn("rank", F.col("before") + F.col("rank")).drop("range", "before")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def prioritised(candidates: DataFrame, limit: int = 5, above: float = 0.6, texts: DataFrame | None = None) -> DataFrame:
    """candidates(qid, chunk_id, text, m, p, n_keywords, score, rank) to the selected chunks of each question, place from 0.

    Strong ones first by score, then rank; weak ones only where fewer strong ones than the limit exist. A chunk whose
    tokens overlap a selected one by more than ``above`` is passed over. Without keywords the rank alone decides.
    A question may have any number of candidates: each round takes the first ROUND of those questions that still lack
    some, so that a row holds so many token sets at most, and then drops all twins of what is selected. The first one left
    is thus selected in the next round, so rounds are no more than the limit. texts(chunk_id, text) serves instead of the candidates' text.
    """
    strong = is_strong(F.col("m"), F.col("p"), F.col("n_keywords"))
    key = F.struct(
        F.when(F.col("n_keywords") == 0, 0).when(F.col("strong"), 0).otherwise(1).alias("weak"),
        F.when(F.col("n_keywords") == 0, F.lit(0.0)).otherwise(-F.col("score")).alias("s"),
        "rank", "chunk_id",
    )
    c = candidates.withColumn("strong", strong)
    rest = stored(c.select("qid", F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("n_keywords") == 0).alias("any"), "strong", key.alias("key"), *([] if texts is not None else ["text"])))
    enough = rest.groupBy("qid").agg(F.count_if("strong").alias("n")).filter(F.col("n") >= limit).select("qid", F.lit(False).alias("strong"))
    rest = rest.filter("any or strong").unionByName(rest.filter("not any and not strong").join(enough, ["qid", "strong"], "left_anti"))
    tokens = F.when(F.col("any"), F.array().cast("array<string>")).otherwise(token_set(F.coalesce("text", F.lit(""))))
    twin = lambda done, t: F.exists(done, lambda d: (F.size(d["t"]) > 0) & (F.size(t) > 0) & (jaccard(d["t"], t) > above))
    with_text = lambda df: df if texts is None else df.join(texts.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text"), "chunk_id")
    order = F.row_number().over(Window.partitionBy("qid").orderBy("key"))
    first = lambda df: df.withColumn("i", order).filter(F.col("i") <= ROUND)
    item = F.struct("key", F.col("chunk_id"), tokens.alias("t"))
    taken = F.aggregate("new", F.col("done"), lambda done, x: F.when((F.size(done) >= limit) | twin(done, x["t"]), done).otherwise(F.array_append(done, F.struct(x["chunk_id"], x["t"]))))
    nothing = F.array().cast("array<struct<chunk_id:bigint,t:array<string>>>")
    chosen, selected = None, []
    while chosen is None or not chosen.isEmpty():
        lists = with_text(first(rest)).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("new"))
        lists = lists.withColumn("done", nothing) if chosen is None else lists.join(chosen.select("qid", "done"), "qid", "right").withColumn("new", F.coalesce("new", F.array().cast(lists.schema["new"].dataType)))
        now = stored(lists.select("qid", taken.alias("done"), F.try_element_at("new", F.lit(-1))["key"].alias("last"), (F.size("new") == ROUND).alias("more")))
        over = (F.size("done") >= limit) | ~F.col("more")
        selected.append(now.filter(over).select("qid", "done"))
        chosen = now.filter(~over)
        left = with_text(rest.join(chosen.select("qid", "done", "last"), "qid").filter(F.col("key") > F.col("last")))
        rest = left.filter(~twin(F.col("done"), tokens)).drop("done", "last", *([] if texts is None else ["text"]))
        rest = rest if chosen.isEmpty() else stored(rest)
    return reduce(DataFrame.unionByName, selected).select("qid", F.posexplode("done").alias("place", "x")).select("qid", "place", F.col("x.chunk_id").alias("chunk_id"))
