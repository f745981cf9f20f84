"""Weighted hash tree for shards: region, rack, shard.

At each level a node draws -ln(u) / weight with u from the hash of the key and
the node's path; the smallest draw wins. The draw of a node depends on nothing
but its own path and weight, so a change of weight moves rows only into or out
of the subtree that changed. A tree grows by a region of its own, whose rows
come from all others and whose growth moves no row between the old shards.

Edge cases: a null key is one key; equal keys share a shard; an empty table
gives no rows; a null text has no bytes. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.llm.common import table

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 24, 4, 2
#: Rows of a shard that are numbered together.
SLOT_BLOCK_ROWS = 4_000


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> list[Leaf]:
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight)]


def draw(key: Column, node: str, weight: float) -> Column:
    """Exponential draw of a node for a key: 52 bits of an MD5 digest make u."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key. Only the children of the winner draw at the next level."""

    def descend(leaves: list[Leaf], level: int, path: str) -> Column:
        if level == 3:
            return F.lit(leaves[0].shard)
        groups: dict[int, list[Leaf]] = {}
        for x in leaves:
            if x.weight > 0:
                groups.setdefault(x[level], []).append(x)
        below = {k: descend(v, level + 1, f"{path}{k}.") for k, v in groups.items()}
        if len(groups) == 1:
            return next(iter(below.values()))
        winner = F.array_min(F.array(*(F.struct(draw(key, f"{path}{k}", sum(x.weight for x in v)).alias("d"), F.lit(k).alias("k")) for k, v in groups.items())))["k"]
        return F.element_at(
            F.transform(F.array(winner), lambda w: reduce(lambda rest, k: F.when(w == k, below[k]).otherwise(rest), list(below)[1:], below[next(iter(below))])), 1
        )

    return descend(tree, 0, "")


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def with_slots(df: DataFrame, order: list[str]) -> DataFrame:
    """df (columns shard and __block) with a gapless slot from 0 in each shard, without one task for a shard.

    Rows are numbered within (shard, block); the counts of earlier blocks are added.
    """
    counts = df.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("shard", "__block").orderBy(*order)
    numbered = df.withColumn("__row", F.row_number().over(own))
    return numbered.join(starts, ["shard", "__block"]).withColumn("slot", F.col("__start") + F.col("__row") - 1).drop("__start", "__row", "__block")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = even_tree(SHARDS)
    blocks = max(8, -(-docs.count() // (SHARDS * SLOT_BLOCK_ROWS)))
    key, text = key_text(F.col("doc_id")), F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, tree).alias("shard"),
        place(key, grown(tree)).alias("grown_shard"),
        F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(blocks)).alias("__block"),
    )
    placed = with_slots(rows, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
