"""Best-fit packing of documents into bins of CAPACITY words, under conflicts.

A document is cut into full pieces, which fill bins of their own, and a rest.
Rests go by falling size to the bin with the least room that still fits and is
compatible: no two documents of one source or of one duplicate cluster share a
bin. Bins stand in order of their room and carry bitmaps of sources and
clusters; the search goes from the tightest bin to its successors until one is
compatible, and passes whole rooms whose bins all conflict.

Documents fall into groups of about GROUP by hash, which are packed apart: a
task holds the lengths of one group, never a text.

Edge cases: a document without words gets a row with no bin; a null source is
a source, a null text an own cluster; repeated rows are documents of one
cluster; ties go by doc_id, then source; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.llm.common import table, words

CAPACITY = 2048
GROUP = 8192
SCHEMA = "doc_id long, source string, piece int, first_word long, n_words long, bin_group int, bin int, place int"


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(size, source bits, cluster bits) in packing order, sizes from 1 to capacity, to (bin, place in it)."""
    rooms: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    #: Bits that all bins of a room share; may name fewer after a bin has left.
    shared = [(0, 0)] * (capacity + 1)
    filled = 0
    sources: list[int] = []
    clusters: list[int] = []
    counts: list[int] = []
    out = []

    def put(b: int, room: int) -> None:
        nonlocal filled
        s, c = shared[room] if rooms[room] else (-1, -1)
        shared[room] = (s & sources[b], c & clusters[b])
        rooms[room][b] = None
        filled |= 1 << room

    for size, s, c in items:
        room, left, found = size, filled >> size, -1
        while left:
            step = (left & -left).bit_length() - 1
            room, left = room + step, left >> step
            if not (shared[room][0] & s or shared[room][1] & c):
                found = next((b for b in rooms[room] if not (sources[b] & s or clusters[b] & c)), -1)
                if found >= 0:
                    break
            room, left = room + 1, left >> 1
        if found < 0:
            found, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
            counts.append(0)
        else:
            del rooms[room][found]
            if not rooms[room]:
                filled &= ~(1 << room)
        sources[found] |= s
        clusters[found] |= c
        out.append((found, counts[found]))
        counts[found] += 1
        put(found, room - size)
    return out


def packed_group(group: pa.Table, capacity: int) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda x: (-(x["n"] % capacity), x["doc_id"] is None, x["doc_id"] or 0, x["source"] or "", x["cluster"]))
    count: dict[int, int] = {}
    for x in rows:
        count[x["cluster"]] = count.get(x["cluster"], 0) + 1
    source_bit: dict[str | None, int] = {}
    cluster_bit: dict[int, int] = {}
    rests = [x for x in rows if x["n"] % capacity]
    items = []
    for x in rests:
        s = source_bit.setdefault(x["source"], 1 << len(source_bit))
        c = cluster_bit.setdefault(x["cluster"], 1 << len(cluster_bit)) if count[x["cluster"]] > 1 else 0
        items.append((x["n"] % capacity, s, c))
    bins = pack(items, capacity)
    places = {id(x): b for x, b in zip(rests, bins, strict=True)}
    free = max((b for b, _ in bins), default=-1) + 1
    out = []
    for x in rows:
        own, full = (x["doc_id"], x["source"]), x["n"] // capacity
        for i in range(full):
            out.append((*own, i, i * capacity, capacity, x["g"], free, 0))
            free += 1
        if x["n"] % capacity:
            out.append((*own, full, full * capacity, x["n"] % capacity, x["g"], *places[id(x)]))
        elif not full:
            out.append((*own, 0, 0, 0, None, None, None))
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """One row for each piece of a document. cluster: a column of duplicate-cluster numbers; equal texts if None."""
    groups = max(1, -(-docs.count() // GROUP))
    own = F.monotonically_increasing_id()
    same = F.col(cluster).cast("long") if cluster else F.xxhash64("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.size(words(F.col("text"))).cast("long").alias("n"),
        F.when(F.col("text").isNull(), -own).otherwise(same).alias("cluster"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), -own)), F.lit(groups)).cast("int").alias("g"),
    )
    return rows.groupBy("g").applyInArrow(lambda group: packed_group(group, capacity), SCHEMA)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def fill(pieces: DataFrame) -> DataFrame:
    """Bins with their words and documents."""
    return pieces.filter("bin is not null").groupBy("bin_group", "bin").agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("pieces"))
