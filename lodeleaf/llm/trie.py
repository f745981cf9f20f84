"""Prefix trie of conversations by Spark SQL's ROLLUP over positional turn columns.

A turn is its MD5 of role and text with the text's length behind it. A stretch of columns holds so many positions of
a conversation; ROLLUP over them, by the node at which the stretch starts, makes all prefixes of all stretches at once,
and grouping_id tells their depth. A node at the start of a stretch is known beforehand by an MD5 over the one at the start
of the stretch before and the turns between, so that no stretch waits for another and the number of jobs does not
depend on the longest conversation. A node is named by its depth and its smallest member. Sums over subtrees come from a
second ROLLUP: every node counts at its smallest member, which brings to each stretch what it has from there on.

A node's ids of conversations that end there are hashed in their order: they pass through one task as a sorted
stream of numbers, of which it keeps the running hash alone. Texts are never shuffled.

Edge cases: rows without conv_id belong to no conversation; null role or text is empty; null turns come first, and
rows of equal turn are ordered by their MD5. A conversation may be left without turns; it is a member of the root
alone. Without conversations there is no node, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.llm.common import stored, table

#: Positions of the first stretches; the last number holds for all further ones.
WIDTHS = (8,)
#: Bytes of a turn's id: MD5 and length.
TURN_BYTES = 20
FAMILY, LONGEST = 100, 5


def turn_id(role: Column, text: Column) -> Column:
    """MD5 of role and text, and the text's code points as four bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.length(text)), 8, "0")))


def turn_chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substr(turn, F.lit(17), F.lit(4))), 16, 10).cast("long")


def positions(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to (conv_id, pos, turn): turns as ids, from position 1."""
    rows = conversations.filter("conv_id is not null").select("conv_id", F.col("turn").alias("at"), turn_id(F.col("role"), F.col("text")).alias("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """positions() to (conversations: conv_id and n; turns: conv_id, pos, turn), each with the beginning of its family's first.

    Conversation c begins with the first h turns of c - c % FAMILY, h being crc32(c) % 6, and goes on with its own after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (LONGEST + 1)).cast("int")
    own = rows.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), h.alias("h"))
    heads = rows.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= LONGEST)).select(F.col("conv_id").alias("family"), "pos", "turn")
    lent = stored(own.join(heads, "family").filter("pos <= h").select("conv_id", "pos", "turn"))
    taken = lent.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("k"))
    rest = rows.withColumn("h", h).filter("pos > h").join(taken, "conv_id", "left").select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("k", F.lit(0))).alias("pos"), "turn")
    turns = stored(lent.unionByName(rest))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return stored(own.select("conv_id").join(lengths, "conv_id", "left").fillna(0, ["n"])), turns


def names() -> list[str]:
    return [f"t{i}" for i in range(1, max(WIDTHS) + 1)]


def base_of(pos: Column) -> Column:
    """Positions before the stretch of a position."""
    bases = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    base = pos - 1 - (pos - 1 - bases[-1]) % WIDTHS[-1]
    for i in range(len(bases) - 1, 0, -1):
        base = F.when(pos <= bases[i], bases[i - 1]).otherwise(base)
    return base.cast("int")


def hashed(node: Column, turns: Column) -> Column:
    """The node under another one after some turns."""
    return F.unhex(F.md5(F.concat(node, turns)))


def whole() -> Column:
    """A row's turns in the stretch."""
    return F.concat(*(F.coalesce(t, F.lit(b"")) for t in names()))


def stretches(members: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, n, base, node, t1, ...): each conversation's stretches, of which one without turns has an empty first. node: where it starts."""
    own = turns.select("conv_id", base_of(F.col("pos")).alias("base"), "pos", "turn")
    wide = stored(own.groupBy("conv_id", "base").agg(*(F.max(F.when(F.col("pos") - F.col("base") == i, F.col("turn"))).alias(t) for i, t in enumerate(names(), 1))))
    line = wide.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("base", whole().alias("turns")))).alias("line"))
    chain = F.aggregate(F.slice("line", F.lit(1), F.size("line") - 1), F.array(F.lit(b"")), lambda done, x: F.array_append(done, hashed(F.element_at(done, -1), x["turns"])))
    starts = line.select("conv_id", F.explode(F.arrays_zip(F.col("line")["base"].alias("base"), chain.alias("node"))).alias("x")).select("conv_id", "x.base", "x.node")
    rows = members.join(wide.join(starts, ["conv_id", "base"]), "conv_id", "left")
    return stored(rows.select("conv_id", "n", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("node", F.lit(b"")).alias("node"), *names()))


def rolled(rows: DataFrame, measures: str) -> DataFrame:
    """rows(base, node, t1, ...) to one row for each node and prefix, with at (depth in the stretch) and measures; starts of later stretches stand in those before."""
    listed = ", ".join(names())
    sql = f"SELECT base, node, {listed}, {len(names())} - bit_count(grouping_id(base, node, {listed})) AS at, {measures} FROM {{rows}} GROUP BY base, node, ROLLUP({listed})"
    last = F.element_at(F.array(*names()), F.greatest("at", F.lit(1)))
    return rows.sparkSession.sql(sql, rows=rows).filter(((F.col("at") == 0) & (F.col("base") == 0)) | ((F.col("at") > 0) & last.isNotNull())).withColumn("depth", F.col("base") + F.col("at"))


def here() -> Column:
    """The node of a row of rolled()."""
    return F.when(F.col("at") == 0, F.col("node")).otherwise(hashed(F.col("node"), whole()))


def prefixes(rows: DataFrame) -> DataFrame:
    """The nodes: (depth, id, conv_id, parent_conv_id, n_convs, chars, leaf)."""
    found = rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest")
    last = turn_chars(F.element_at(F.array(*names()), F.greatest("at", F.lit(1))))
    above = F.when(F.col("at") == 1, F.col("node")).when(F.col("at") > 1, hashed(F.col("node"), F.substr(whole(), F.lit(1), TURN_BYTES * (F.col("at") - 1))))
    found = stored(found.select("depth", here().alias("id"), above.alias("above"), "conv_id", "n_convs", F.when(F.col("at") > 0, last).otherwise(0).alias("chars"), (F.col("longest") == F.col("depth")).alias("leaf")))
    upper = found.select((F.col("depth") + 1).alias("depth"), F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return stored(found.join(upper, ["depth", "above"], "left").drop("above"))


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, conv_id, n_leaves, saved_tokens) of all nodes."""
    at = [f"s{i}" for i in range(1, len(names()) + 1)]
    owned = nodes.filter("depth > 0").select("conv_id", "depth", base_of(F.col("depth")).alias("base"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    owned = owned.groupBy("conv_id", "base").agg(*(F.coalesce(F.sum(F.when(F.col("depth") - F.col("base") >= i, F.col("saved"))), F.lit(0)).alias(s) for i, s in enumerate(at, 1)))
    leaves = nodes.filter("leaf").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    rows = rows.join(owned, ["conv_id", "base"], "left").join(leaves, "conv_id", "left").fillna(0, [*at, "leaf"])
    further = F.coalesce(F.sum("s1").over(Window.partitionBy("conv_id").orderBy(F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("further", further).select("conv_id", "base", "node", *names(), "leaf", *((F.col(s) + F.col("further")).alias(s) for s in at))
    out = rolled(rows, "min(conv_id) AS conv_id, sum(leaf) AS n_leaves, " + ", ".join(f"sum({s}) AS {s}" for s in at))
    return out.select("depth", "conv_id", "n_leaves", F.element_at(F.array(*at), F.greatest("at", F.lit(1))).alias("saved_tokens"))


def running_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, conv_id, end) to a SHA-256 of each (depth, conv_id)'s ends, comma-joined."""
    now, state = None, hashlib.sha256()

    def row(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([digest])], ["depth", "conv_id", "sha"])

    for batch in batches:
        for depth, conv, end in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "end"))):
            if (depth, conv) != now:
                if now is not None:
                    yield row(now, state.hexdigest())
                now, state = (depth, conv), hashlib.sha256()
            else:
                state.update(b",")
            state.update(str(end).encode())
    if now is not None:
        yield row(now, state.hexdigest())


def trie(conversations: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = rebuilt) -> DataFrame:
    """The nodes of all conversations' prefixes, as op12 returns them; build(positions) makes the conversations and their turns."""
    members, turns = build(stored(positions(conversations)))
    rows = stretches(members, turns)
    nodes = prefixes(rows)
    out = stored(nodes.select("depth", "conv_id", "parent_conv_id", "n_convs").join(subtree_sums(rows, nodes), ["depth", "conv_id"]))
    children = out.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    last = rows.filter((F.col("n") == 0) | (F.col("base") == base_of(F.col("n")))).select(F.col("n").alias("depth"), F.when(F.col("n") == 0, F.col("node")).otherwise(hashed(F.col("node"), whole())).alias("id"), F.col("conv_id").alias("end"))
    ended = last.join(nodes.select("depth", "id", "conv_id"), ["depth", "id"]).select("depth", "conv_id", "end")
    ended = ended.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "end")
    hashes = ended.mapInArrow(running_hashes, "depth int, conv_id long, sha string")
    return out.join(children, ["depth", "conv_id"], "left").join(hashes, ["depth", "conv_id"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
