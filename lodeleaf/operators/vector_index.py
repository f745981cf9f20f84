"""An inverted file of vectors: rows in lists around centroids, of which a search reads only those that may hold near ones.

Centroids are fitted by k-means on a bounded sample; every row is assigned to its nearest one and stored in a folder
of its list with its distance to it. A search probes the lists nearest to each query. From the k-th distance found so
far and the lists' radii follows which other lists may hold nearer rows; they are probed in growing rounds until none
is left, which makes the result certain, or the search stops after a stated number of probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeleaf.operators.vector import QUERY_BYTES, matrix, scanning
from lodeleaf.sources.scratch import bounded_batches, stored

#: Lists, at most, and rows of the sample for each. Both bound what the driver and every task hold: centroids and sample.
LISTS, SAMPLE_PER_LIST = 4096, 64
#: Lists that each query probes first, and how many times as many each further round adds.
PROBES, WIDEN = 8, 4



def centre_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)
    return np.sqrt(np.maximum(squares, 0.0))


def assigning(sent, keep: list[str]):
    """Rows with their list and their distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"))
                nearest = centre_distances(x, centres).argmin(1)
                gap = np.sqrt(((x - centres[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(gap), pa.array(nearest.astype(np.int32))], [*keep, "gap", "list"])

    return run


def probes_of(sent, query: str, most: int):
    """Queries (query, qvec, cut, done) to the lists to probe next: the nearest ``most`` that are not done and may hold rows within cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            far = centre_distances(matrix(batch.column("qvec")), centres)
            cut = np.sqrt(np.array([np.inf if c is None else c for c in batch.column("cut").to_pylist()]))
            open_ = np.maximum(far - radius, 0.0) <= (cut * (1 + 1e-9) + 1e-9)[:, None]
            for i, done in enumerate(batch.column("done").to_pylist()):
                open_[i, done] = False
            order = np.argsort(far, axis=1, kind="stable")
            probes = [[int(j) for j in o[open_[i, o]][:most]] for i, o in enumerate(order)]
            yield pa.RecordBatch.from_arrays([batch.column(query), batch.column("qvec"), batch.column("cut"), pa.array(probes, pa.list_(pa.int32()))], [query, "qvec", "cut", "probes"])

    return run


class VectorIndex:
    """root/lists/list=0 ... with the rows (row, vec and other columns, gap), root/centroids(list, centre, n, radius)."""

    def __init__(self, spark: SparkSession, root: str, row: str = "chunk_id"):
        self.spark, self.root, self.row = spark, root.rstrip("/"), row
        self.lists = spark.read.parquet(f"{self.root}/lists")
        found = spark.read.parquet(f"{self.root}/centroids").orderBy("list").collect()
        self.centres = np.array([r["centre"] for r in found]).reshape(len(found), -1)
        self.radius = np.array([r["radius"] for r in found])

    @classmethod
    def build(cls, rows: DataFrame, root: str, row: str = "chunk_id", lists: int | None = None, seed: int = 7) -> VectorIndex:
        """rows(row, vec, ...): every row with a vector as long as most is stored; null ones and those of other lengths cannot be near.

        There are as many lists as the root of the rows' number, LISTS at most. The sample are the rows whose hashed id
        lies below a bound that lets about SAMPLE_PER_LIST for each list pass. Rebalancing splits lists that hold many rows.
        Without rows nothing is written, and the index finds nothing.
        """
        spark = rows.sparkSession
        bounded_batches(spark)
        rows = rows.filter("vec is not null").withColumn("vec", F.transform("vec", lambda x: x.cast("double"))).filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
        sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
        dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
        keep = rows.columns
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        if not n:
            return cls.empty(spark, root, row, kinds)
        rows = rows.filter(F.size("vec") == dim)
        k = lists or max(1, min(LISTS, int(n**0.5)))
        share = min(1.0, SAMPLE_PER_LIST * k / n)
        sample = rows.filter(F.pmod(F.xxhash64(row), F.lit(1 << 30)) < int(share * (1 << 30))).select(array_to_vector("vec").alias("features"))
        sample = stored(sample)
        if k > 1 and sample.count() > k:
            centres = np.array(KMeans(k=k, seed=seed, maxIter=10, initMode="random").fit(sample).clusterCenters())
        else:
            centres = np.array(rows.select("vec").first()["vec"], float).reshape(1, dim)
        assigned = rows.mapInArrow(assigning(spark.sparkContext.broadcast(centres), keep), f"{kinds}, gap double, list int")
        assigned.hint("rebalance", "list").write.partitionBy("list").option("compression", "zstd").parquet(f"{root}/lists")
        there = spark.read.schema(f"{kinds}, gap double, list int").parquet(f"{root}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
        spots = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        spots.join(there, "list", "left").select("list", "centre", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(float("-inf"))).alias("radius")).coalesce(1).write.parquet(f"{root}/centroids")
        return cls(spark, root, row)

    @classmethod
    def empty(cls, spark: SparkSession, root: str, row: str, kinds: str) -> VectorIndex:
        index = cls.__new__(cls)
        index.spark, index.root, index.row = spark, root, row
        index.lists = spark.createDataFrame([], f"{kinds}, gap double, list int")
        index.centres, index.radius = np.zeros((1, 0)), np.zeros(1)
        return index

    def search(self, queries: DataFrame, k: int, probes: int | None = None, within: DataFrame | None = None, query: str = "qid") -> DataFrame:
        """queries(query, qvec) to query, row, dist (squared) and rank from 0: the k nearest rows, ties by row.

        probes: lists for each query, after which the search ends; without it, it goes on until the result is certain.
        within(row): only these rows, which are chosen before distances. Queries go to all tasks in passes of QUERY_BYTES.
        """
        bounded_batches(self.spark)
        queries = queries.select(query, F.transform("qvec", lambda x: x.cast("double")).alias("qvec")).filter(F.size("qvec") == self.centres.shape[1])
        n = queries.count()
        passes = max(1, -(-n * max(1, self.centres.shape[1]) * 8 // QUERY_BYTES))
        rows = self.lists.select(self.row, "vec", "list")
        rows = rows if within is None else rows.join(within.select(self.row), self.row, "left_semi")
        out = None
        for i in range(passes):
            own = queries if passes == 1 else queries.filter(F.pmod(F.xxhash64(query), F.lit(passes)) == i)
            found = self._searched(stored(own), rows, k, probes, query)
            out = found if out is None else out.unionByName(found)
        return out

    def _searched(self, queries: DataFrame, rows: DataFrame, k: int, probes: int | None, query: str) -> DataFrame:
        kind = {c: s.schema[c].dataType.simpleString() for c, s in ((query, queries), (self.row, rows))}
        spark, centres = self.spark, self.spark.sparkContext.broadcast((self.centres, self.radius))
        order = F.row_number().over(Window.partitionBy(query).orderBy("dist", self.row)) - 1
        asked = queries.withColumn("cut", F.lit(None).cast("double")).withColumn("done", F.array().cast("array<int>"))
        found, most = None, probes or PROBES
        while True:
            sent = asked.mapInArrow(probes_of(centres, query, most), f"`{query}` {kind[query]}, qvec array<double>, cut double, probes array<int>").toArrow()
            lists = sent["probes"].to_pylist()
            probing: dict[int, list[int]] = {}
            for i, own in enumerate(lists):
                for x in own:
                    probing.setdefault(x, []).append(i)
            if probing:
                to_all = (sent[query].combine_chunks(), matrix(sent["qvec"].combine_chunks()), {x: np.array(q) for x, q in probing.items()}, np.array([np.inf if c is None else c for c in sent["cut"].to_pylist()]))
                near = rows.filter(F.col("list").isin(list(probing))).mapInArrow(scanning(spark.sparkContext.broadcast(to_all), k, self.row, query), f"`{query}` {kind[query]}, `{self.row}` {kind[self.row]}, dist double")
                near = near if found is None else near.unionByName(found.drop("rank"))
                found = stored(near.withColumn("rank", order).filter(F.col("rank") < k))
            if probes or not probing:
                break
            tried = stored(spark.createDataFrame(pa.table({query: sent[query], "now": sent["probes"]})).withColumn("now", F.col("now").cast("array<int>")))
            full = found.groupBy(query).agg(F.max("dist").alias("cut"), F.count(F.lit(1)).alias("n")).select(query, F.when(F.col("n") >= k, F.col("cut")).alias("cut"))
            left = asked.drop("cut").join(tried, query).filter(F.size("now") > 0).join(full, query, "left")
            asked = stored(left.select(query, "qvec", "cut", F.concat("done", "now").alias("done")))
            most *= WIDEN
        if found is None:
            return queries.select(query, F.lit(None).cast(kind[self.row]).alias(self.row), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
        return found

    def recall(self, queries: DataFrame, exact: DataFrame, k: int, probes: int, query: str = "qid") -> DataFrame:
        """query, wanted, met: how many of the exact rows a search with so many probes finds."""
        own = self.search(queries, k, probes, query=query).select(query, self.row, F.lit(1).alias("hit"))
        both = exact.select(query, self.row).join(own, [query, self.row], "left")
        return both.groupBy(query).agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("met"))

    def probes_for(self, queries: DataFrame, k: int, recall: float, query: str = "qid", sample: int = 256) -> int:
        """The fewest probes (1, 2, 4, ...) that reach the recall on about ``sample`` of the queries, measured against their certain results."""
        n = max(1, queries.count())
        some = stored(queries.filter(F.pmod(F.xxhash64(query), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))))
        exact = self.search(some, k, query=query)
        probes = 1
        while probes < len(self.centres):
            got = self.recall(some, exact, k, probes, query).agg(F.sum("wanted").alias("w"), F.sum("met").alias("m")).first()
            if not got["w"] or got["m"] >= recall * got["w"]:
                break
            probes *= 2
        return probes
