"""Hard negatives by exact inner-product search with coordinate pruning.

Vectors are kept in blocks of one label and one range of lengths, of about BLOCK_ROWS rows; a block holds for
each coordinate the order of its normalised values. Anchors are a stated query set: they go to all blocks in
passes of ANCHORS. A score that an anchor still needs bounds the angle to it, given the greatest length in a block:
blocks whose lengths can't reach it are passed over, and where the feasible ranges of an anchor's FOCUS largest
coordinates hold few of a block's rows, only rows in all of these ranges are looked at. Every row looked at is
verified by its exact integer score. First an anchor's positives are searched, among blocks of its label, then the
negatives of each positive in the others. Tasks keep the best of each list and raise the needed score with them.

Edge cases: rows with a null id, label or vector or with a null or non-finite component take no part. Vectors of
different length don't meet. Rows that share an anchor's id are not its positives; repeated rows count each, anchors
too. A positive with a negative score has no negatives. Scores beyond 63 bits stand at the largest number. Empty
tables give none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.llm.common import bounded_batches, small, stored, table

BLOCK_ROWS = 4096
#: Anchors and bytes of them that go to all tasks in one pass.
ANCHORS, ANCHOR_BYTES = 32768, 32 << 20
#: Coordinates of an anchor whose ranges are looked up, and the share of a block's rows up to which they are intersected.
FOCUS, SHARE = 4, 0.25
#: Blocks' lengths lie within a factor of two to the power of this.
STEP = 1 / 8
SCALE = 256.0
MOST = (1 << 63) - 1
BLOCK = "dim int, label int, longest double, largest double, n int, ids binary, kind string, values binary, orders binary"
LISTS = "akey long, slot int, id long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """rows(vec_id, label, embedding) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", F.col("label").cast("int").alias("label"), "embedding").filter("vec_id is not null and label is not null and embedding is not null").filter(finite)


def quantised(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of floor(SCALE * x)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(float) * SCALE).reshape(len(lists), dim)


def built(rows: pa.Table) -> pa.Table:
    """A block from rows of one length, label and range of lengths; rows stand by id."""
    rows = rows.sort_by("vec_id")
    dim, n = rows["dim"][0].as_py(), len(rows)
    v = quantised(rows["embedding"], dim)
    largest = float(np.abs(v).max()) if v.size else 0.0
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    norms = np.sqrt((v * v).sum(1))
    unit = v / np.where(norms > 0, norms, 1.0)[:, None]
    orders = np.argsort(unit.T, axis=1, kind="stable").astype("<u2" if n <= 1 << 16 else "<u4")
    row = [[dim], [rows["label"][0].as_py()], [float(norms.max())], [largest], [n], [rows["vec_id"].to_numpy().astype("<i8").tobytes()], [kind], [v.astype(kind).tobytes()], [orders.tobytes()]]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, t) for x, t in zip(row, types)], names=[c.split()[0] for c in BLOCK.split(", ")])


def index(rows: DataFrame) -> DataFrame:
    """usable() rows as a stored table of blocks."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x * SCALE) * (x * SCALE)))
    keys = ["dim", "label", "bucket"]
    rows = rows.select("vec_id", "label", "embedding", F.size("embedding").alias("dim"), F.coalesce(F.floor(F.log2(norm + 1) / STEP), F.lit(0)).cast("int").alias("bucket"))
    parts = stored(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")))
    dealt = rows.join(small(parts), keys).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")))
    return stored(dealt.groupBy(*keys, "salt").applyInArrow(built, BLOCK))


@dataclass
class Lists:
    """The wanted lists of anchors of one vector length: list i belongs to anchor owner[i] and takes scores from low[i] to high[i]."""

    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    owner: np.ndarray
    slot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.matrix * self.matrix).sum(1))
        self.unit = self.matrix / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.largest = float(np.abs(self.matrix).max()) if self.matrix.size else 0.0
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


class Best:
    """The best k (score, id) of each list so far, and the score that the next one needs."""

    def __init__(self, lists: Lists, k: int):
        self.k, self.need, self.n = k, lists.low.copy(), len(lists.low)
        self.rows, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        rows, scores, ids = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.k
        self.rows, self.scores, self.ids = rows[kept], scores[kept], ids[kept]
        full = rank == self.k - 1
        self.need[rows[full]] = np.maximum(self.need[rows[full]], scores[full])


def exact_scores(a: np.ndarray, largest_a: float, b: np.ndarray, largest_b: float) -> np.ndarray:
    """Integer products of the rows of a with those of b."""
    if largest_a * largest_b * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b))), -MOST, MOST).astype(np.int64)


def feasible(lists: Lists, anchors: np.ndarray, need: np.ndarray, longest: float, unit: np.ndarray, orders: np.ndarray) -> list[np.ndarray | None]:
    """For each anchor the rows of a block that may reach the needed score; None stands for all of them.

    A unit vector within an angle of the anchor has coordinates between the cosines of the anchor's own angle to the axis, more or less that angle.
    """
    n = orders.shape[1]
    angle = np.arccos(np.clip(need / np.maximum(lists.norms[anchors] * longest, 1e-300), -1.0, 1.0))
    focus = lists.focus[anchors]
    own = np.arccos(np.clip(np.take_along_axis(lists.unit[anchors], focus, 1), -1.0, 1.0))
    low = np.cos(np.minimum(own + angle[:, None], np.pi)) - 1e-9
    high = np.cos(np.maximum(own - angle[:, None], 0.0)) + 1e-9
    begin, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
    for f in np.unique(focus):
        values, here = unit[orders[f], f], focus == f
        begin[here], end[here] = np.searchsorted(values, low[here], "left"), np.searchsorted(values, high[here], "right")
    narrow = (end - begin).min(1) <= SHARE * n
    out: list[np.ndarray | None] = []
    for i in range(len(anchors)):
        if not narrow[i] or need[i] <= 0:
            out.append(None)
            continue
        met = np.zeros(n, np.int8)
        for j, f in enumerate(focus[i]):
            met[orders[f, begin[i, j] : end[i, j]]] += 1
        out.append(np.flatnonzero(met == focus.shape[1]))
    return out


def searched(block: dict, lists: Lists, best: Best, same: bool) -> None:
    """One block for all lists whose anchors have its label (or another)."""
    n, dim = block["n"], block["dim"]
    wanted = (lists.labels[lists.owner] == block["label"]) == same
    wanted &= (lists.low <= lists.high) & (lists.norms[lists.owner] * block["longest"] * (1 + 1e-9) >= best.need)
    live = np.flatnonzero(wanted)
    if not len(live):
        return
    v = np.frombuffer(block["values"], block["kind"]).astype(float).reshape(n, dim)
    ids = np.frombuffer(block["ids"], "<i8")
    anchors, place = np.unique(lists.owner[live], return_inverse=True)
    need = np.full(len(anchors), MOST)
    np.minimum.at(need, place, best.need[live])
    rows: list[np.ndarray | None] = [None] * len(anchors)
    if dim and (need > 0).any():
        norms = np.sqrt((v * v).sum(1))
        orders = np.frombuffer(block["orders"], "<u2" if n <= 1 << 16 else "<u4").reshape(dim, n)
        rows = feasible(lists, anchors, need, block["longest"], v / np.where(norms > 0, norms, 1.0)[:, None], orders)
    whole = [i for i, r in enumerate(rows) if r is None]
    groups = [(np.array(whole, np.int64), np.arange(n))] if whole else []
    groups += [(np.array([i]), r) for i, r in enumerate(rows) if r is not None and len(r)]
    for some, cols in groups:
        scores = exact_scores(lists.matrix[anchors[some]], lists.largest, v[cols], block["largest"])
        at = np.full(len(anchors), -1)
        at[some] = np.arange(len(some))
        mine = live[at[place] >= 0]
        for part in np.array_split(mine, max(1, len(mine) * len(cols) // (1 << 22))):
            own = scores[at[np.searchsorted(anchors, lists.owner[part])]]
            fits = (own >= best.need[part][:, None]) & (own <= lists.high[part][:, None])
            if same:
                fits &= ids[cols][None, :] != lists.ids[lists.owner[part]][:, None]
            r, c = np.nonzero(fits)
            best.add(part[r], own[r, c], ids[cols][c])


def search(sent, k: int, same: bool):
    """Blocks to the best k of each list, as LISTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, Lists] = sent.value
        best = {dim: Best(x, k) for dim, x in lists.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if block["dim"] in lists:
                    searched(block, lists[block["dim"]], best[block["dim"]], same)
        for dim, b in best.items():
            x = lists[dim]
            for part in np.array_split(np.arange(len(b.rows)), max(1, len(b.rows) >> 16)):
                r = b.rows[part]
                yield pa.RecordBatch.from_arrays([pa.array(x.keys[x.owner[r]]), pa.array(x.slot[r].astype(np.int32)), pa.array(b.ids[part]), pa.array(b.scores[part])], ["akey", "slot", "id", "score"])

    return run


def lists_of(anchors: pa.Table, wanted: dict[int, list[tuple[int, int, int]]]) -> dict[int, Lists]:
    """Anchors (akey, vec_id, label, embedding) with the (slot, low, high) wanted of each, by vector length."""
    sizes = np.array([len(x) for x in anchors["embedding"].to_pylist()])
    out = {}
    for dim in np.unique(sizes):
        own = anchors.filter(pa.array(sizes == dim))
        keys = own["akey"].to_numpy()
        flat = [(i, *w) for i, key in enumerate(keys.tolist()) for w in wanted.get(key, [])]
        owner, slot, low, high = (np.array([f[j] for f in flat], np.int64) for j in range(4))
        out[int(dim)] = Lists(keys, own["vec_id"].to_numpy(), own["label"].to_numpy(), quantised(own["embedding"], int(dim)), owner, slot, low, high)
    return out


def mined(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """rows(vec_id, label, embedding) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; negatives score from low to high percent of the positive.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = usable(rows)
    blocks = index(rows)
    anchors = stored(rows.filter(F.col("vec_id") % every == 0).withColumn("akey", F.monotonically_increasing_id()))
    n, size = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("embedding") + 64), F.lit(0))).first()
    passes = max(1, -(-n // ANCHORS), -(-size // ANCHOR_BYTES))
    own = lambda df, i: df.filter(F.pmod(F.xxhash64("akey"), F.lit(passes)) == i)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near, far = None, None
    for i in range(passes):
        sent = own(anchors, i).toArrow()
        lists = lists_of(sent, {key: [(0, -MOST, MOST)] for key in sent["akey"].to_pylist()})
        found = stored(best(blocks.mapInArrow(search(spark.sparkContext.broadcast(lists), positives, True), LISTS), positives))
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for r in found.collect():
            wanted.setdefault(r["akey"], []).append((r["rank"], -(-low * r["score"] // 100), high * r["score"] // 100))
        lists = lists_of(sent, wanted)
        met = stored(best(blocks.mapInArrow(search(spark.sparkContext.broadcast(lists), negatives, False), LISTS), negatives))
        near, far = (a if b is None else b.unionByName(a) for a, b in ((found, near), (met, far)))
    pairs = near.select("akey", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(pairs, ["akey", "slot"]).join(anchors.select("akey", F.col("vec_id").alias("anchor_id")), "akey")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_focus_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "embedding"))
