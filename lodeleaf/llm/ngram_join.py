"""Near duplicates: a Jaccard join of word shingles by token-combination prefixes.

Tokens are the distinct 5-word shingles of a document. A document with n
tokens may lack at most e = n - ceil(0.75 n) of them in any partner. Tokens
have one global order: those of a single document first, then other rare ones,
then frequent ones by group. A prefix is extended until its signatures can't
all be missed:

- each rare token is a signature and covers one unit;
- a group with c frequent tokens gives all its pairs and covers c - 1 units,
  since a partner that shares no pair shares at most one token of the group;
- the prefix ends when e + 1 units are covered.

Groups depend on the size zone (a power of four), with half as many groups as
the zone's least size, so every document can cover e + 1 units. A document
near a zone's end gives signatures in the next zone too, where its larger
partners are. Any order and any choice of frequent tokens gives the same
links; they decide the number of candidates only.

Plan: 1. shingle counts over all texts, packed by hash range; the most frequent
make the frequent class, and a bitmap by hash marks those of two documents or
more (one that marks too many changes the order, not the links). 2. Signatures, packed by hash range; within a task
and again within a range, holders of a signature are linked to its smallest
document, so a bucket of m documents gives m - 1 candidates. Equal sets are
linked by a 128-bit digest. 3. Candidates are verified on whole sets. 4. Where
a candidate fails, documents are held against PIVOTS of their bucket; then all
pairs of failed buckets that still lie across components are verified, so no
link that could join components is lost: in small buckets as listed pairs, in
larger ones in blocks of token sets, which give out only links that join two
components.

Edge cases: a null or empty text has no shingles and no links; rows of one id
are one document; a null id gets a row with its count and no component; texts
of any length count whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.llm.common import bounded_batches, small, stored, table
from lodeleaf.llm.components import components
from lodeleaf.llm.shingles import U, mix, shingle_sets, texts

#: Least similarity in percent.
SIMILARITY = 75
#: Documents that hold a frequent token, at least.
FREQUENT = 64
#: Tokens of the frequent class, at most: the most frequent. It is the size of the one broadcast table (16 bytes each).
FREQUENT_TOKENS = 1 << 18
#: Bits of the bitmap of shared tokens for each document, and the most bits in all (as a power of two; 32 MB).
SHARED_BITS, MOST_SHARED_BITS = 256, 28
#: Documents of a bucket that its others are first held against, where candidates failed.
PIVOTS = 8
#: Documents of a bucket up to which its pairs are listed; larger buckets are compared in blocks.
LISTED = 8
#: Tokens of the documents that stand in one row of a block (a longer document stands alone).
PART_TOKENS = 1 << 16
#: Least hash ranges that counts and signatures are dealt into, and documents for which one set of them serves.
RANGES, DOCS_PER_RANGES = 256, 4_000_000
#: Tokens that a task holds before it gives out what it has.
FLUSH = 500_000
ZONE = 32
#: Signatures are compared by so many bits; what collides is told apart on verification.
SIGNATURE_BITS = 48
PAIR = 0xD6E8FEB86659FD93
PACKED = "r int, kind int, x binary, a binary, b binary, na binary, nb binary"
LINKS = "kind string, sig long, a long, b long, na long, nb long, va long, vb long, bits binary"


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Little-endian bytes by significance, which leaves runs of zeros to the shuffle's compression."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, width: int = 8) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def delta(values: np.ndarray, width: int) -> bytes:
    return planes(np.diff(values, prepend=U(0)), width)


def undelta(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(unplanes(data, width), dtype=U)


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return np.flatnonzero(first)


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, at its hash modulo a power of two of at least twice their number."""
    bits = np.zeros(bitmap_size(len(tokens)) * 8, np.uint8)
    bits[tokens & U(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bitmap_size(n: int) -> int:
    return max(8, 1 << max(0, (2 * n - 1).bit_length() - 3))


def most_shared(na: int, nb: int, a: bytes, b: bytes) -> int:
    """An upper bound of the overlap: a bit set in one bitmap only stands for a token that the other set lacks."""
    size = min(len(a), len(b))
    one, two = (int.from_bytes(np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0).tobytes() if len(x) > size else x) for x in (a, b))
    return min(na - (one & ~two).bit_count(), nb - (two & ~one).bit_count())


# ---------------------------------------------------------------- frequent tokens


def key_of(tokens: np.ndarray) -> np.ndarray:
    """What tokens are counted by: 40 bits are enough to tell rare from frequent."""
    return tokens >> U(24)


def counter(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        starts = (np.arange(ranges, dtype=U) * U((1 << 40) // ranges)) if ranges else None

        def give() -> pa.RecordBatch:
            keys, counts = np.unique(key_of(np.concatenate(held)), return_counts=True)
            cut = [*np.searchsorted(keys, starts).tolist(), len(keys)]
            own = [(i, a, b) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in own], pa.int32()), pa.array([delta(keys[a:b], 5) for _, a, b in own], pa.binary()), pa.array([planes(counts[a:b], 4) for _, a, b in own], pa.binary())], ["r", "x", "n"]
            )

        for batch in batches:
            for _, offsets, data in texts(batch.column(0)):
                sets = shingle_sets(offsets, data)
                held += sets
                size += sum(map(len, sets))
                if size >= FLUSH:
                    yield give()
                    held, size = [], 0
        if size:
            yield give()

    return run


def shared_slot(keys: np.ndarray, bits: int) -> np.ndarray:
    """A key's place in the slice of the bitmap that its hash range has."""
    return (mix(keys) & U(bits - 1)).astype(np.int64)


def counted(group: pa.Table, bits: int) -> pa.Table:
    """The frequent keys of a range, and in a row without key the range's slice of the bitmap of shared tokens."""
    keys = np.concatenate([undelta(x, 5) for x in group["x"].to_pylist()])
    counts = np.concatenate([unplanes(n, 4) for n in group["n"].to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    keys, sums = keys[order][first], np.add.reduceat(counts[order], first)
    shared = np.zeros(bits, np.uint8)
    shared[shared_slot(keys[sums > 1], bits)] = 1
    often = sums >= FREQUENT
    n = int(often.sum())
    return pa.table(
        [
            pa.array([group["r"][0].as_py()] * (n + 1), pa.int32()),
            pa.concat_arrays([pa.array(keys[often].astype(np.int64)), pa.nulls(1, pa.int64())]),
            pa.concat_arrays([pa.array(sums[often]), pa.nulls(1, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([np.packbits(shared).tobytes()], pa.binary())]),
        ],
        names=["r", "key", "n", "bits"],
    )


class Classes(NamedTuple):
    """What decides the order of tokens: sorted keys of the frequent class; the bitmap of shared tokens, by hash range."""

    frequent: np.ndarray
    shared: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """0: of one document, 1: rare, 2: frequent."""
        keys = key_of(tokens)
        ranges, bits = self.shared.shape[0], self.shared.shape[1] * 8
        slot = shared_slot(keys, bits)
        out = (self.shared[(keys >> U(40 - ranges.bit_length() + 1)).astype(np.int64), slot >> 3] >> (7 - (slot & 7)) & 1).astype(np.int8)
        if len(self.frequent):
            where = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
            out[self.frequent[where] == keys] = 2
        return out


def token_classes(docs: DataFrame, ranges: int, count: int) -> Classes:
    """The frequent class holds tokens of at least FREQUENT documents, and of the most frequent FREQUENT_TOKENS at most."""
    bits = max(1 << 8, min(1 << MOST_SHARED_BITS, 1 << (SHARED_BITS * max(1, count) - 1).bit_length()) // ranges)
    packed = docs.select("text").mapInArrow(counter(ranges), "r int, x binary, n binary")
    found = stored(packed.groupBy("r").applyInArrow(lambda group: counted(group, bits), "r int, key long, n long, bits binary"))
    least = FREQUENT
    while found.filter(F.col("n") >= least).count() > FREQUENT_TOKENS:
        least *= 2
    keys = found.filter(F.col("n") >= least).select("key").toArrow().column(0).to_numpy()
    shared = np.zeros((ranges, bits // 8), np.uint8)
    for row in found.filter("bits is not null").select("r", "bits").toLocalIterator():
        shared[row["r"]] = np.frombuffer(row["bits"], np.uint8)
    return Classes(np.sort(keys.astype(U)), shared)


# ---------------------------------------------------------------- signatures


def zone(n: int) -> int:
    z = 0
    while n > ZONE << (2 * z):
        z += 1
    return z


def signatures(tokens: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The prefix signatures of a sorted token set and its tokens' classes."""
    n = len(tokens)
    frequent = kind == 2
    rare = np.concatenate([tokens[kind == 0], tokens[kind == 1]])
    need = n - -(-SIMILARITY * n // 100) + 1
    if len(rare) >= need:
        return rare[:need]
    need -= len(rare)
    often = tokens[frequent]
    out = [rare]
    for z in {zone(n), zone(100 * n // SIMILARITY)}:
        if z == 0:
            out.append(often[:need])
            continue
        groups = mix(often ^ U(z)) % U((ZONE << (2 * (z - 1))) // 2)
        order = np.argsort(groups, kind="stable")
        own, left = often[order], need
        bounds = [*runs(groups[order]).tolist(), len(own)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            c = min(b - a, left + 1)
            if c > 1:
                i, j = np.triu_indices(c, 1)
                out.append(mix(own[a + i] * U(PAIR) + own[a + j] + U(z)))
                left -= c - 1
            if left <= 0:
                break
    return np.concatenate(out)


def signer(classes, ranges: int):
    """Packed rows by kind. 0: signatures and their smallest holder; 1: candidates within the task; 2: digests of sets; 3: equal sets within the task; 4: documents; 5: counts of documents without id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_of = classes.value.of
        ids: list[int | None] = []
        sets: list[np.ndarray] = []
        size, turn = 0, 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            turn += 1
            rows = list(flushed(ids, sets, kinds_of, ranges, turn))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in PACKED.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, offsets, data in texts(batch.column(1)):
                found = shingle_sets(offsets, data)
                ids += names[first : first + len(found)]
                sets += found
                size += sum(map(len, found)) + 100 * len(found)
                if size >= FLUSH:
                    yield from give()
                    ids, sets, size = [], [], 0
        if ids:
            yield from give()

    return run


def flushed(ids: list[int | None], sets: list[np.ndarray], kinds_of: Callable[[np.ndarray], np.ndarray], ranges: int, turn: int) -> Iterator[tuple]:
    none = b""
    spread = lambda k: hash((ids[0], turn, k)) % ranges
    anonymous = [len(s) for i, s in zip(ids, sets, strict=True) if i is None]
    if anonymous:
        yield spread(5), 5, none, none, none, planes(np.array(anonymous, U), 4), none
    known = sorted((i, k) for k, i in enumerate(ids) if i is not None)
    if not known:
        return
    own = [sets[k] for _, k in known]
    doc = np.array([i for i, _ in known], np.int64).astype(U)
    n = np.array(list(map(len, own)), U)
    yield spread(4), 4, b"".join(map(bitmap, own)), planes(doc), none, planes(n, 4), none
    # Equal sets: the smallest id stands for all.
    full = np.flatnonzero(n)
    if not len(full):
        return
    flat = np.concatenate([own[i] for i in full])
    at = np.append(0, np.cumsum(n[full]).astype(np.int64))
    one = np.add.reduceat(mix(flat), at[:-1])
    two = np.bitwise_xor.reduceat(mix(flat ^ U(PAIR)), at[:-1]) ^ n[full]
    order = np.lexsort((two, one))
    first = np.ones(len(full), bool)
    first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(full)), 0))]
    copies = order != head
    if copies.any():
        yield spread(3), 3, none, planes(doc[full[head[copies]]]), planes(doc[full[order[copies]]]), none, none
    lead = order[~copies]
    lead = lead[np.argsort(one[lead], kind="stable")]
    top = one[lead] >> U(64 - (ranges.bit_length() - 1))
    for r, a, b in split(top):
        yield r, 2, planes(one[lead[a:b]]), planes(doc[full[lead[a:b]]]), planes(two[lead[a:b]]), none, none
    # Signatures of one document for each set.
    kind = kinds_of(flat)
    found = [(i, signatures(flat[at[i] : at[i + 1]], kind[at[i] : at[i + 1]])) for i in np.sort(lead).tolist()]
    # Size, and above it the tokens that any other document may hold.
    sized = n.copy()
    sized[full] |= np.add.reduceat((kind > 0).astype(U), at[:-1]) << U(32)
    sig = np.concatenate([s for _, s in found]) >> U(64 - SIGNATURE_BITS)
    holder = np.repeat(np.array([i for i, _ in found]), [len(s) for _, s in found])
    order = np.argsort(sig, kind="stable")
    sig, holder = sig[order], full[holder[order]]
    first = runs(sig)
    rep = np.repeat(first, np.diff(np.append(first, len(sig))))
    again = np.flatnonzero(rep != np.arange(len(sig)))
    again = again[holder[again] != holder[rep[again]]]
    if len(again):
        a, b = holder[rep[again]], holder[again]
        yield spread(1), 1, planes(sig[again]), planes(doc[a]), planes(doc[b]), planes(sized[a]), planes(sized[b])
    sig, holder = sig[first], holder[first]
    shift = U(SIGNATURE_BITS - ranges.bit_length() + 1)
    for r, a, b in split(sig >> shift):
        yield r, 0, delta(sig[a:b] - (U(r) << shift), 5), planes(doc[holder[a:b]]), none, planes(sized[holder[a:b]]), none


def split(sorted_ranges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    first = runs(sorted_ranges)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sorted_ranges)], strict=True):
        yield int(sorted_ranges[a]), a, b


def met(group: pa.Table, ranges: int) -> pa.Table:
    """The links of one hash range."""
    rows = group.to_pylist()
    of = lambda kind: [x for x in rows if x["kind"] == kind]
    out = []

    def put(kind: str, **columns: np.ndarray) -> None:
        size = max(map(len, columns.values()))
        own = [pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(size, pa.int64()) for c in ("sig", "a", "b", "na", "nb", "va", "vb")]
        bits = pa.array(columns["bits"], pa.binary()) if "bits" in columns else pa.nulls(size, pa.binary())
        out.append(pa.table([pa.array([kind] * size, pa.string()), *own, bits], names=[f.split()[0] for f in LINKS.split(", ")]))

    def near(sig: np.ndarray, a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> None:
        put("near", sig=sig, a=a, b=b, na=sa & U(2**32 - 1), nb=sb & U(2**32 - 1), va=sa >> U(32), vb=sb >> U(32))

    for x in of(1):
        near(unplanes(x["x"]), unplanes(x["a"]), unplanes(x["b"]), unplanes(x["na"]), unplanes(x["nb"]))
    for x in of(3):
        put("same", a=unplanes(x["a"]), b=unplanes(x["b"]))
    for x in of(4):
        n = unplanes(x["na"], 4)
        ends = np.cumsum([bitmap_size(k) for k in n.tolist()]).tolist()
        put("doc", a=unplanes(x["a"]), na=n, bits=[x["x"][i:j] for i, j in zip([0, *ends], ends, strict=False)])
    for x in of(5):
        put("doc", na=unplanes(x["na"], 4))
    if own := of(0):
        sig = np.concatenate([undelta(x["x"], 5) for x in own])
        doc = np.concatenate([unplanes(x["a"]) for x in own]).astype(np.int64)
        n = np.concatenate([unplanes(x["na"]) for x in own])
        order = np.lexsort((doc, sig))
        sig, doc, n = sig[order], doc[order], n[order]
        first = runs(sig)
        rep = np.repeat(first, np.diff(np.append(first, len(sig))))
        again = np.flatnonzero(doc != doc[rep])
        base = U(own[0]["r"]) << U(SIGNATURE_BITS - ranges.bit_length() + 1)
        near(sig[again] + base, doc[rep[again]], doc[again], n[rep[again]], n[again])
    if own := of(2):
        one, doc, two = (np.concatenate([unplanes(x[c]) for x in own]) for c in ("x", "a", "b"))
        doc = doc.astype(np.int64)
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        first = np.ones(len(one), bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        rep = np.maximum.accumulate(np.where(first, np.arange(len(one)), 0))
        again = np.flatnonzero(doc != doc[rep])
        put("same", a=doc[rep[again]], b=doc[again])
    return pa.concat_tables(out)


# ---------------------------------------------------------------- verification


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, offsets, data in texts(batch.column(1)):
            sets = shingle_sets(offsets, data)
            ends = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)).cast(pa.int64()), pa.ListArray.from_arrays(ends, values)], ["id", "tokens"])


def token_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of the documents named in ids(doc_id); of rows with one id, one."""
    sets = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").mapInArrow(set_rows, "id long, tokens array<long>")
    return stored(sets)


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True)
        keep = [100 * (most := most_shared(na, nb, xa, xb)) >= SIMILARITY * (na + nb - most) for na, nb, xa, xb in rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar(pairs: DataFrame, bitmaps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs(a, b) of which 100 * intersection >= SIMILARITY * union; bitmaps: (id, n, bits)."""
    named = lambda c: bitmaps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    left = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    pairs = stored(left.mapInArrow(possible, "a long, b long").distinct())
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = token_sets(docs, ids)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return stored(both.filter(100 * shared >= SIMILARITY * (F.size("ta") + F.size("tb") - shared)).select("a", "b").distinct())


def sizes_fit(na: str, va: str, nb: str, vb: str) -> Column:
    """Whether two documents of n tokens, v of which any other may hold, can be similar enough."""
    most = F.least(va, vb)
    return 100 * most >= SIMILARITY * (F.col(na) + F.col(nb) - most)


def failed_buckets(links: DataFrame, failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, d, n, v, m): the m holders of signatures that a failed pair across components shares; of buckets with the same holders one.

    A bucket of two documents has been verified as a whole, and is left out.
    """
    label = labels.select(F.col("id").alias("d"), "component")
    named = lambda df, c: df.join(label.withColumnRenamed("d", c).withColumnRenamed("component", f"c{c}"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    apart = named(named(failed.select("a", "b"), "a"), "b").filter("ca <> cb").select("a", "b")
    near = links.filter("kind = 'near'")
    inside = near.join(near.join(apart, ["a", "b"], "left_semi").select("sig").distinct(), "sig", "left_semi")
    held = inside.select("sig", F.col("a").alias("d"), F.col("na").alias("n"), F.col("va").alias("v")).unionByName(inside.select("sig", F.col("b").alias("d"), F.col("nb").alias("n"), F.col("vb").alias("v"))).distinct()
    held = stored(held)
    alike = held.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("y"))
    return stored(held.join(alike.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).filter("m > 2").select("sig", "m"), "sig"))


def labelled(held: DataFrame, labels: DataFrame) -> DataFrame:
    """held of buckets with several components, with component c and the largest component of the bucket, most."""
    held = stored(held.join(labels.select(F.col("id").alias("d"), "component"), "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component"))
    most = held.groupBy("sig", "c").count().groupBy("sig").agg(F.max_by("c", F.struct("count", "c")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return stored(held.join(most.select("sig", "most"), "sig"))


def against_pivots(held: DataFrame) -> DataFrame:
    """Each document outside its bucket's largest component, in the largest such bucket, with PIVOTS of the bucket of other components."""
    lowest = F.row_number().over(Window.partitionBy("sig").orderBy(F.xxhash64("d"), "d"))
    pivots = held.withColumn("i", lowest).filter(F.col("i") <= PIVOTS).groupBy("sig").agg(F.collect_list(F.struct("d", "n", "v", "c")).alias("pivots"))
    own = held.filter("c <> most").groupBy("d", "n", "v", "c").agg(F.max_by("sig", F.struct("m", "sig")).alias("sig"))
    pairs = own.join(pivots, "sig").select(F.col("d").alias("d1"), F.col("n").alias("n1"), F.col("v").alias("v1"), F.col("c").alias("c1"), F.explode("pivots").alias("p"))
    pairs = pairs.filter((F.col("p.c") != F.col("c1")) & sizes_fit("n1", "v1", "p.n", "p.v"))
    return pairs.select(F.least("d1", "p.d").alias("a"), F.greatest("d1", "p.d").alias("b")).distinct()


def listed(held: DataFrame) -> DataFrame:
    """All pairs of different components in buckets of at most LISTED documents."""
    row = F.collect_list(F.struct("d", "n", "v", "c"))
    rows = held.filter(F.col("m") <= LISTED).groupBy("sig").agg(row.alias("xs"))
    pairs = rows.select(F.explode("xs").alias("x"), "xs").select("x", F.explode("xs").alias("y")).filter("x.d < y.d and x.c <> y.c")
    return pairs.filter(sizes_fit("x.n", "x.v", "y.n", "y.v")).select(F.col("x.d").alias("a"), F.col("y.d").alias("b")).distinct()


class Part(NamedTuple):
    """Documents that stand in one row: ids, components, where the tokens of each begin, all tokens."""

    d: np.ndarray
    c: np.ndarray
    first: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, rows: pa.ListScalar) -> Part:
        x = rows.values
        d, c, tokens = (x.field(i) for i in range(3))
        return cls(d.to_numpy(), c.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(tokens).to_numpy())), tokens.flatten().to_numpy())


def links_between(one: Part, two: Part) -> Iterator[tuple[int, int]]:
    """Similar pairs of two parts that join two components each: fewer than there are documents."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    vocabulary, at = np.unique(two.tokens, return_inverse=True)
    sizes = np.diff(two.first)
    own = np.searchsorted(vocabulary, one.tokens)
    own[own == len(vocabulary)] = 0
    there = vocabulary[own] == one.tokens
    mark = np.zeros(len(vocabulary), bool)
    for i in range(len(one.d)):
        span = slice(one.first[i], one.first[i + 1])
        mine = own[span][there[span]]
        mark[mine] = True
        both = np.add.reduceat(mark[at], two.first[:-1], dtype=np.int64)
        mark[mine] = False
        n = int(one.first[i + 1] - one.first[i])
        for j in np.flatnonzero((100 * both >= SIMILARITY * (n + sizes - both)) & (two.c != one.c[i])).tolist():
            a, b = root(int(one.c[i])), root(int(two.c[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield int(one.d[i]), int(two.d[j])


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
            found = list(links_between(Part.of(one), Part.of(two)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def in_blocks(held: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join components in buckets of more than LISTED documents.

    A document goes into a part of its largest bucket, of about PART_TOKENS tokens; those of the bucket's largest component have
    parts of their own. Two parts that meet in a bucket are compared once, on whole sets, unless both hold one component only.
    """
    large = held.filter(F.col("m") > LISTED)
    home = large.groupBy("d", "n", "c").agg(F.max_by(F.struct("sig", (F.col("c") == F.col("most")).alias("main")), F.struct("m", "sig")).alias("h")).select("d", "n", "c", "h.sig", "h.main")
    sizes = home.groupBy("sig", "main").agg(F.ceil(F.sum("n") / PART_TOKENS).alias("parts"))
    home = stored(home.join(sizes, ["sig", "main"]).select("d", "c", F.xxhash64("sig", "main", F.pmod(F.xxhash64("d"), "parts")).alias("p")))
    one = home.groupBy("p").agg(F.when(F.min("c") == F.max("c"), F.min("c")).alias("one"))
    met = stored(large.select("sig", "d").join(home.select("d", "p"), "d").select("sig", "p").distinct().join(one, "p"))
    pairs = met.select("sig", F.col("p").alias("p1"), F.col("one").alias("c1")).join(met.select("sig", F.col("p").alias("p2"), F.col("one").alias("c2")), "sig")
    pairs = stored(pairs.filter((F.col("p1") <= F.col("p2")) & ~F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))).select("p1", "p2").distinct())
    sets = token_sets(docs, home.select(F.col("d").alias("doc_id")))
    part = sets.filter(F.size("tokens") > 0).join(home, F.col("id") == F.col("d")).groupBy("p").agg(F.collect_list(F.struct("d", "c", "tokens")).alias("rows"))
    part = stored(part)
    side = lambda i, name: part.select(F.col("p").alias(f"p{i}"), F.col("rows").alias(name))
    return pairs.join(side(1, "one"), "p1").join(side(2, "two"), "p2").select("one", "two").mapInArrow(block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id: one row for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = docs.count()
    ranges = RANGES << (max(1, -(-count // DOCS_PER_RANGES)) - 1).bit_length()
    classes = spark.sparkContext.broadcast(token_classes(docs, ranges, count))
    links = stored(docs.mapInArrow(signer(classes, ranges), PACKED).groupBy("r").applyInArrow(lambda group: met(group, ranges), LINKS))
    pairs = stored(links.filter("kind = 'near'").groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("na", "va", "nb", "vb"))).select("a", "b", sizes_fit("na", "va", "nb", "vb").alias("fits")))
    bitmaps = links.filter("kind = 'doc' and a is not null").select(F.col("a").alias("id"), F.col("na").alias("n"), "bits")
    linked = similar(pairs.filter("fits"), bitmaps, docs)
    edges = stored(links.filter("kind = 'same'").select("a", "b").unionByName(linked))
    labels = stored(components(edges))
    failed = stored(pairs.join(linked, ["a", "b"], "left_anti"))
    held = failed_buckets(links, failed, labels)
    tested = failed.filter("fits").select("a", "b")
    for choose in (against_pivots, listed):
        more = stored(choose(labelled(held, labels)).join(tested, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            edges = edges.unionByName(similar(more, bitmaps, docs))
            labels = stored(components(edges))
            tested = tested.unionByName(more)
    apart = labelled(held, labels)
    if not apart.filter(F.col("m") > LISTED).isEmpty():
        joining = stored(in_blocks(apart, docs))
        if not joining.isEmpty():
            labels = stored(components(edges.unionByName(joining)))
    rows = links.filter("kind = 'doc'").select(F.col("a").alias("id"), F.col("na").alias("n_shingles"))
    return rows.join(labels, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates of smaller id, with the columns they came with; of rows with one id any one, and all rows without id."""
    found = stored(near_duplicates(docs))
    out = stored(found.filter("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(small(out), "doc_id", "left_anti")
    twice = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    twice = small(stored(twice))
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
