"""Mixing sources to target weights, in DataFrame functions only.

1. Sources get targets by weight, capped at MAX_REPEAT times their size.
2. Documents fall into blocks by hash. A source takes all its blocks as often
   as they fit whole into the target; of the next round, blocks in permuted
   order as long as they fit, and a part of one more block, up to the document nearest to the target.
3. The block quotas of all sources are split among output shards by a binary
   tree. At each node the counts of the left half are drawn from the
   multivariate hypergeometric distribution, as a chain of hypergeometric
   draws over sources, so shards have equal numbers of blocks and exact sums.
4. A shard takes the next of each source's permuted blocks; no two shards get
   the same draw. Rows are dealt by shard and shuffled by hash within it.

Sources are a table of one task: thousands, not millions.

Everything is a function of doc_id, the seed and the totals: reruns agree.

Edge cases: a null source is a source, last in order; a null text has size 0;
a document without words follows its block; repeated rows go together; an
empty table gives no rows; sources without words have target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.llm.common import let, small, stored, table, words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Blocks of all sources together, besides one for each source, at least, and for each shard.
BLOCKS, BLOCKS_A_SHARD = 4096, 32
#: Output shards, at least; a power of two. Larger mixes get as many as keep a shard to about SHARD_WORDS.
SHARDS, SHARD_WORDS = 16, 1 << 27
SEED = 17


def targets(sources: DataFrame) -> DataFrame:
    """sources(source, source_size) with weight and target: a water level over the ratios of cap to weight.

    In order of that ratio, a source is capped if the level left by those before it is above its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("__rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("__rank") - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("__cap", (MAX_REPEAT * F.col("source_size")).cast("double"))
    by_ratio, everything = Window.orderBy(F.col("__cap") / F.col("weight"), "__rank"), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("__level", left / rest).withColumn("__full", F.col("__cap") <= F.col("__level") * F.col("weight"))
    s = s.withColumn("__capped", F.min("__full").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.first(F.when(~F.col("__capped"), F.col("__level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("target", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.least(F.col("__cap"), level * F.col("weight"))))
    return s.select("source", "source_size", "n_docs", "weight", "target", (F.col("__rank") - 1).alias("s"))


def hypergeometric(u: Column, items: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` out of ``items``, of which some are ``marked``, are marked; u in (0, 1) picks by inverse distribution.

    Log weights follow from the ratio of neighbours; they are scaled by their maximum.
    """
    items, marked, drawn = (c.cast("long") for c in (items, marked, drawn))
    low, high = F.greatest(F.lit(0).cast("long"), drawn + marked - items), F.least(marked, drawn)

    def step(lw: Column, x: Column, n: Column, k: Column, m: Column, lo: Column) -> Column:
        num, den = (k - x + 1).cast("double") * (m - x + 1), x.cast("double") * (n - k - m + x)
        return F.when(x == lo, F.lit(0.0)).otherwise(lw + F.log(num) - F.log(den))

    def pick(a: Column) -> Column:
        n, k, m, lo, hi, u01 = (a[c] for c in ("n", "k", "m", "lo", "hi", "u"))
        weight = lambda lw, x: step(lw, x, n, k, m, lo)
        logs = F.aggregate(F.sequence(lo, hi), F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("top")), lambda s, x: let(weight(s["lw"], x), lambda w: F.struct(w.alias("lw"), F.greatest(s["top"], w).alias("top"))))

        def scaled(top: Column) -> Column:
            sums = F.aggregate(F.sequence(lo, hi), F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum")), lambda s, x: let(weight(s["lw"], x), lambda w: F.struct(w.alias("lw"), (s["sum"] + F.exp(w - top)).alias("sum"))))
            return let(
                u01 * sums["sum"],
                lambda goal: F.aggregate(
                    F.sequence(lo, hi),
                    F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("sum"), hi.alias("x")),
                    lambda s, x: let(weight(s["lw"], x), lambda w: F.struct(w.alias("lw"), (s["sum"] + F.exp(w - top)).alias("sum"), F.when((s["sum"] < goal) & (s["sum"] + F.exp(w - top) >= goal), x).otherwise(s["x"]).alias("x"))),
                )["x"],
            )

        return F.when(lo >= hi, hi).otherwise(let(logs["top"], scaled))

    return let(F.struct(items.alias("n"), marked.alias("k"), drawn.alias("m"), low.alias("lo"), high.alias("hi"), u.alias("u")), pick)


def uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(s, quota) to (s, shard, q): one row per tree node holds the quotas of all sources; levels double the rows."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("s", F.col("quota").cast("long").alias("q")))).alias("qs")).select(F.lit(1).alias("node"), "qs")
    for _ in range(int(math.log2(shards))):

        def fold(qs: Column, at: Column) -> Column:
            size = F.aggregate(qs, F.lit(0).cast("long"), lambda a, x: a + x["q"])
            start = F.struct(size.alias("n"), F.floor(size / 2).cast("long").alias("m"), F.array().cast("array<bigint>").alias("out"))

            def one(a: Column, x: Column) -> Column:
                got = hypergeometric(uniform(F.lit(seed), at, x["s"]), a["n"], x["q"], a["m"])
                return let(got, lambda g: F.struct((a["n"] - x["q"]).alias("n"), (a["m"] - g).alias("m"), F.array_append(a["out"], g).alias("out")))

            return F.aggregate(qs, start, one)["out"]

        split = node.select("node", "qs", fold(F.col("qs"), F.col("node")).alias("left"))
        side = lambda right: F.transform("qs", lambda x, i: F.struct(x["s"].alias("s"), (x["q"] - F.get("left", i) if right else F.get("left", i)).alias("q")))  # noqa: E731, B023
        node = stored(split.select("node", F.explode(F.array(F.struct(F.lit(0).alias("b"), side(False).alias("qs")), F.struct(F.lit(1).alias("b"), side(True).alias("qs")))).alias("x")).select((F.col("node") * 2 + F.col("x.b")).alias("node"), "x.qs"))
    return node.select((F.col("node") - shards).alias("shard"), F.explode("qs").alias("x")).select("x.s", "shard", "x.q")


def shards_for(total: float) -> int:
    """The number of output shards of a mix of so many words."""
    return SHARDS << max(0, math.ceil(math.log2(max(1.0, total / SHARD_WORDS / SHARDS))))


def block_plan(sized: DataFrame, sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per (s, block) with draws: array of (epoch, shard, part) and, for a block taken in part, the last order key that goes in."""
    weights = stored(sized.groupBy("s", "block").agg(F.sum("size").alias("w")))
    # Of the round that doesn't fit whole: blocks in permuted order, each taken if it fits into what is left.
    full = F.least(F.lit(MAX_REPEAT), F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") + 1e-9).otherwise(F.lit(0))))
    lists = weights.groupBy("s").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "s", "block").alias("h"), "block", "w"))).alias("bs"))
    lists = lists.join(small(sources.select("s", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("left"))), "s")
    fold = F.aggregate(
        "bs",
        F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<boolean>").alias("took")),
        lambda a, b: let(b["w"] <= a["left"], lambda ok: F.struct((a["left"] - F.when(ok, b["w"]).otherwise(F.lit(0))).alias("left"), F.array_append(a["took"], ok).alias("took"))),
    )
    picked = lists.select("s", "full", "bs", fold.alias("f")).select("s", "full", "f.left", F.posexplode(F.arrays_zip(F.col("bs"), F.col("f.took").alias("took"))).alias("p", "x"))
    picked = picked.select("s", "full", "left", "p", "x.bs.block", "x.bs.w", F.col("x.took").alias("took"))
    # The smallest block that did not fit gives a part of itself.
    rest = Window.partitionBy("s", "took").orderBy("w", "p")
    picked = stored(picked.withColumn("part", ~F.col("took") & (F.row_number().over(rest) == 1) & (F.col("left") >= 1)))
    edge = small(picked.filter("part").select("s", "block", "left"))
    running = Window.partitionBy("s").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sized.join(edge, ["s", "block"]).withColumn("sum", F.sum("size").over(running))
    cuts = inside.filter(F.col("sum") - F.col("size") / 2 <= F.col("left")).groupBy("s").agg(F.max("key").alias("cut"))
    picked = picked.join(small(stored(cuts)), "s", "left").withColumn("part", F.col("part") & F.col("cut").isNotNull())
    draws = picked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full").cast("int")))).filter("epoch < full or took or part")
    order = Window.partitionBy("s").orderBy("epoch", "p")
    draws = stored(draws.select("s", "block", "epoch", "cut", (F.col("part") & (F.col("epoch") == F.col("full"))).alias("part"), (F.row_number().over(order) - 1).alias("j")))
    leaves = shard_quotas(draws.groupBy("s").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    ends = leaves.select("s", "shard", F.sum("q").over(Window.partitionBy("s").orderBy("shard")).alias("end")).groupBy("s").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    draws = draws.join(small(stored(ends)), "s").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("j"))))
    return stored(draws.groupBy("s", "block").agg(F.max("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("epoch", "shard", "part"))).alias("draws")))


def planned(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """docs with the columns __source_name, s, size, block and key; the sources; the block plan; the number of shards."""
    size = F.size(words(F.col("text"))).cast("long")
    narrow = stored(docs.select("doc_id", "source", size.alias("size")))
    sources = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))))
    shards = shards_for(sources.agg(F.sum("target")).first()[0] or 0.0)
    return narrow, sources, block_plan(blocked(narrow, sources, shards, seed), sources, shards, seed), shards


def blocked(df: DataFrame, sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df (doc_id, source) with its source's number s, a block and an order key."""
    share = F.col("source_size") / F.greatest(F.sum("source_size").over(Window.partitionBy()), F.lit(1))
    names = sources.select(F.col("source").alias("__source"), "s", F.greatest(F.lit(1), F.least(F.col("n_docs"), F.ceil(share * max(BLOCKS, BLOCKS_A_SHARD * shards)))).alias("__blocks"))
    out = df.join(small(names), F.col("source").eqNullSafe(F.col("__source")))
    out = out.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("__blocks")))
    return out.withColumn("key", F.xxhash64("doc_id", F.lit(seed + 1))).drop("__source", "__blocks")


def kept_draws() -> Column:
    """The draws of a document: all of its block's, but of a partial one only up to the cut."""
    return F.filter(F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int,part:boolean>>")), lambda d: ~d["part"] | (F.col("key") <= F.col("cut")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, sources, plan, shards = planned(table(spark, sf_dir, "documents"))
    rows = blocked(narrow, sources, shards).join(small(plan), ["s", "block"], "left").withColumn("__d", kept_draws())
    rows = rows.join(small(sources.select("s", "source_size", "target")), "s")
    return rows.select("doc_id", "size", "source_size", "target", (F.size("__d") * F.col("size")).cast("long").alias("taken"), F.concat_ws(",", F.transform("__d", lambda d: d["shard"].cast("string"))).alias("shards"))


def sharded(docs: DataFrame) -> DataFrame:
    """The mix: every document as often as it was drawn, with the columns it came with and __shard.

    A shard's rows stand in one task, shuffled by hash; a task may hold several shards, one after the other.
    """
    _, sources, plan, shards = planned(docs)
    named = docs.select(F.col("doc_id"), F.col("source"), F.struct(*docs.columns).alias("__row"))
    rows = blocked(named, sources, shards).join(small(plan), ["s", "block"]).select("__row", "key", F.explode(kept_draws()).alias("__d"))
    rows = rows.select("__row", F.col("__d.shard").alias("__shard"), F.xxhash64("key", "__d.epoch").alias("__order"))
    return rows.repartition(shards, "__shard").sortWithinPartitions("__shard", "__order").select("__row.*", "__shard")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix in the order of its shards, with the columns of docs."""
    return sharded(docs).select(*docs.columns)
