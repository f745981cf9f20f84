"""Parquet tables in folders by a hash of their key, which are buckets of that key too: lookups read the key's folder, joins and groups by key move no row of the table, and a change rewrites only the folders it touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeleaf.sources.scratch import stored


class KeyedTable:
    """Rows(key, ...) under root/part=0 to root/part=parts-1; part is the number that Spark's buckets have.

    The files are registered in the session's catalog as an external table, partitioned and bucketed, under a name of this object's own.
    One writer at a time. A reader that listed files before a change has to read anew if they are gone.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, parts: int = 64, order: tuple[str, ...] = ()):
        self.spark, self.root, self.key, self.parts, self.order = spark, root.rstrip("/"), key, parts, order
        self.name: str | None = None
        self.schema: T.StructType | None = None

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _part(self):
        """As Spark numbers buckets."""
        return F.pmod(F.hash(self.key), F.lit(self.parts))

    def exists(self) -> bool:
        fs, path = self._path()
        return fs.exists(path) and any(s.getPath().getName().startswith("part=") for s in fs.listStatus(path))

    def _register(self, more: T.StructType | None = None) -> None:
        """The table over what is stored, with columns that rows to come have more.

        It is made once, and again under another name if columns come; each use brings its folders up to date. It is
        never dropped, since a DataFrame read before asks for it when it runs.
        """
        fs, path = self._path()
        if self.schema is None:
            self.schema = self.spark.read.option("mergeSchema", "true").parquet(self.root).drop("part").schema if self.exists() else T.StructType()
        new = [f for f in (more.fields if more else []) if f.name not in self.schema.names]
        if new or self.name is None:
            self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*self.schema.fields, *new]])
            name = f"lodeleaf_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            sorted_ = ", ".join(f"`{c}`" for c in (self.order or (self.key,)))
            self.spark.sql(f"CREATE TABLE {name} ({columns}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (`{self.key}`) SORTED BY ({sorted_}) INTO {self.parts} BUCKETS LOCATION '{self.root}'")
            self.name = name
        if fs.exists(path):
            self.spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")

    def _table(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(f"nothing in {self.root}")
        self._register()
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self._table().drop("part")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys(key): only the folders that these can lie in are read, and no row of them is moved."""
        keys = stored(keys.select(self.key).distinct())
        touched = [r[0] for r in keys.select(self._part()).distinct().collect()]
        rows = self._table().filter(F.col("part").isin(touched)).drop("part")
        return rows.join(keys, self.key, "left_semi")

    def _write(self, rows: DataFrame, overwrite: bool) -> None:
        self._register(rows.schema)
        columns = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        dealt = rows.select(*columns, self._part().cast("int").alias("part")).repartition(self.parts, self.key)
        writer = dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite" if overwrite else "append")
        name, mode = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(name, "dynamic")
        try:
            writer.insertInto(self.name, overwrite=overwrite)
        finally:
            self.spark.conf.set(name, mode)

    def append(self, rows: DataFrame) -> None:
        """More rows; what is there stays as it is."""
        self._write(rows, False)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame | None], DataFrame | None]) -> None:
        """The folders of keys(key) anew, with what change makes of their rows (null if there is no table); it keeps rows of other keys as they are.

        Folders that are left without rows go first: a failure after that leaves some keys out, which a next synchronisation brings again, and none that should be gone.
        """
        touched = [r[0] for r in keys.select(self._part()).distinct().collect()]
        rows = change(self._table().filter(F.col("part").isin(touched)).drop("part") if self.exists() else None) if touched else None
        if rows is None:
            return
        rows = stored(rows)
        left = {r[0] for r in rows.select(self._part()).distinct().collect()}
        for part in set(touched) - left:
            fs, path = self._path(f"part={part}")
            fs.delete(path, True)
        if left:
            self._write(rows, True)

    def replace(self, gone: DataFrame, new: DataFrame | None = None) -> None:
        """The rows of the keys in gone(key) go, and so do those of keys that new brings anew."""
        keys = stored((gone.select(self.key) if new is None else gone.select(self.key).unionByName(new.select(self.key))).distinct())

        def change(there: DataFrame | None) -> DataFrame | None:
            kept = None if there is None else there.join(keys, self.key, "left_anti")
            return kept if new is None else new if kept is None else kept.unionByName(new, allowMissingColumns=True)

        self.rewrite(keys, change)


class ChunkStore(KeyedTable):
    """Chunks(source, ...) by source."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        super().__init__(spark, root, "source", parts)

    def delete(self, source: str) -> int:
        """Chunks of the source that went; an unknown source is an error."""
        own = self.spark.createDataFrame([(source,)], "source string")
        n = self.lookup(own).count() if self.exists() else self.read().count()
        if not n:
            raise KeyError(source)
        self.replace(own)
        return n
