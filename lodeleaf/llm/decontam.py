"""Benchmark decontamination: prefix-filtered containment of item windows in documents, in DataFrame functions only.

Words are runs of digits, letters a-z (A-Z are lowered) and characters beyond ASCII. A window is WINDOW consecutive
words of an item, or the whole item if it has fewer. Its tokens are its SHINGLE-word shingles. All of them have to
occur, so its necessary prefix, by rarity in the documents, is the rarest one alone, and a window of which one
occurs nowhere is out. One pass over the documents stores where sought tokens stand. Places of prefix tokens give
windows with their place in the text: positional and length bounds ask that they fit into it. Candidates are
compared word by word with the text.

Texts are told by 128 bits of hashes, so that copies are compared once; windows by the MD5 of their words, tokens
by 64 bits, which the comparison makes good. The sought tokens go to all tasks in passes of BROADCAST_BYTES. Hits
move by text and place, candidates meet texts that hold any; a text's candidates stand in one row, as its words do.

Edge cases: null and empty texts have no words, and items without words no windows. An item without an id marks
words, but isn't counted or listed. Items of equal id count once. Repeated documents are judged alike, whatever
their ids. Without items nothing is hit; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.llm.common import BROADCAST_BYTES, let, small, stored, table

WINDOW = 10
SHINGLE = 3
#: What a sought token takes in a broadcast relation.
TOKEN_BYTES = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that part words.
PARTS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
KEY = ["k1", "k2"]
#: Stands after a document's last token; its place and not its value tells it.
END = 0


def item_words(text: Column) -> Column:
    """Lower-case words; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), PARTS + UPPER, " " * len(PARTS) + LOWER), " "), "")


def shingled(words: Column, k: int) -> Column:
    """Hashes of all k consecutive words."""
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    if k == 1:
        return hashed
    joint = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))
    return let(hashed, lambda h: F.slice(joint(h), F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.coalesce(text, F.lit("")), F.lit(i)).alias(k) for i, k in enumerate(KEY)]


def windows(items: DataFrame, window: int) -> DataFrame:
    """items(item_id, text) to (item_id, wid, w, tokens): w are a window's words."""
    rows = items.select("item_id", item_words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, F.lit(window)))).alias("w"))
    tokens = F.when(F.size("w") >= SHINGLE, shingled(F.col("w"), SHINGLE))
    for k in range(1, SHINGLE):
        tokens = tokens.when(F.size("w") == k, shingled(F.col("w"), k))
    return rows.select("item_id", F.md5(F.array_join("w", " ")).alias("wid"), "w", tokens.alias("tokens"))


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, last, at, token): where documents hold tokens of windows, and one row with last for each document."""
    spark = docs.sparkSession
    sought = stored(found.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), F.explode("tokens").alias("token")).distinct())
    sizes = {r["k"]: r["n"] for r in sought.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    passes = [(k, i, -(-sizes[k] * TOKEN_BYTES // BROADCAST_BYTES)) for k in sorted(sizes, reverse=True) for i in range(-(-sizes[k] * TOKEN_BYTES // BROADCAST_BYTES))]
    out = None
    for k, i, n in passes or [(SHINGLE, 0, 1)]:
        own = sought.filter((F.col("k") == k) & (F.pmod(F.col("token"), F.lit(n)) == i)).select("token")
        if out is None:
            own = own.unionByName(spark.range(1).select(F.lit(END).cast("long").alias("token"))).distinct()
        measured = let(item_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(shingled(w, k), F.array(F.lit(END).cast("long"))).alias("tokens")))  # noqa: B023
        rows = docs.select("doc_id", *text_key(F.col("text")), measured.alias("m"))
        rows = rows.select("doc_id", *KEY, F.col("m.n_words").alias("n_words"), (F.size("m.tokens") - 1).alias("end"), F.posexplode("m.tokens").alias("at", "token"))
        rows = rows.join(F.broadcast(own), "token").select("doc_id", *KEY, "n_words", (F.col("at") == F.col("end")).alias("last"), "at", "token")
        out = rows if out is None else out.unionByName(rows.filter(~F.col("last")))
    return stored(out)


def candidates(places: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, start, wid, w): windows that may stand at a place of a text, by their rarest token and the room around it."""
    rarity = stored(places.filter(~F.col("last")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    tokens = found.select("wid", "w", F.posexplode("tokens").alias("offset", "token")).distinct()
    ranked = tokens.join(small(rarity), "token", "left").groupBy("wid", "w").agg(F.min(F.struct("n", "token", "offset")).alias("rare"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    prefix = stored(ranked.filter("whole").select("wid", "w", F.col("rare.token").alias("token"), F.col("rare.offset").alias("offset")))
    start = F.col("at") - F.col("offset")
    met = places.filter(~F.col("last")).join(small(prefix), "token")
    return met.filter((start >= 0) & (start + F.size("w") <= F.col("n_words"))).select(*KEY, start.alias("start"), "wid", "w").distinct()


def merged(spans: Column) -> Column:
    """Sorted (start, end), of words, as spans that neither meet nor overlap."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        grown = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), longer)
        return F.when(x["start"] <= last["end"], grown).otherwise(F.array_append(done, x))

    return F.aggregate(F.array_sort(spans), none, step)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) and items(item_id, text) to (doc_id, n_words, spans, item_ids), one row for each document.

    spans: array of (start, end) in words, that windows of items cover; item_ids: those items as strings, sorted.
    """
    docs = docs.select("doc_id", "text")
    found = stored(windows(items.select("item_id", "text"), window))
    places = hits(docs, found)
    maybe = stored(candidates(places, found))
    listed = maybe.groupBy(*KEY).agg(F.collect_list(F.struct("start", "wid", "w")).alias("c"))
    texts = docs.select("text", *text_key(F.col("text"))).join(small(maybe.select(*KEY).distinct()), KEY, "left_semi").dropDuplicates(KEY)
    equal = lambda w: F.filter("c", lambda x: F.slice(w, x["start"] + 1, F.size(x["w"])) == x["w"])
    sure = texts.join(listed, KEY).select(*KEY, let(item_words(F.col("text")), equal).alias("c"))
    sure = stored(sure.filter(F.size("c") > 0).select(*KEY, F.transform("c", lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.size(x["w"])).alias("end"))).alias("s"), F.array_distinct(F.transform("c", lambda x: x["wid"])).alias("wids")))
    named = found.select("wid", F.col("item_id").cast("string").alias("item_id")).distinct()
    owners = sure.select(*KEY, F.explode("wids").alias("wid")).join(small(named), "wid").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    spans = sure.select(*KEY, merged(F.col("s")).alias("spans"))
    result = stored(spans.join(owners, KEY))
    out = places.filter("last").select("doc_id", *KEY, "n_words").join(small(result), KEY, "left")
    none = [F.array().cast(result.schema[c].dataType) for c in ("spans", "item_ids")]
    return out.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("item_ids", none[1]).alias("item_ids"))


def op13_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
