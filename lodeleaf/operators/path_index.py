"""The index of path tokens as stored tables that are kept up by what a synchronisation changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeleaf.functions.paths import path_tokens
from lodeleaf.sources.scratch import stored
from lodeleaf.sources.store import KeyedTable


class PathIndex:
    """root/tokens (token, source) by source, so that a token of many sources lies in many folders, and root/counts (token, n) by token."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark = spark
        self.tokens = KeyedTable(spark, f"{root}/tokens", "source", parts, ("token", "source"))
        self.counts = KeyedTable(spark, f"{root}/counts", "token", parts)

    def read(self) -> DataFrame:
        """(token, source), what augment.token_index() makes of all paths."""
        return self.tokens.read().filter("token is not null").select("token", "source") if self.tokens.exists() else self.spark.createDataFrame([], "token string, source string")

    def numbers(self) -> DataFrame:
        """(token, n): the sources that each token names."""
        return self.counts.read() if self.counts.exists() else self.spark.createDataFrame([], "token string, n long")

    def update(self, steps: DataFrame) -> None:
        """Carry out sync.plan() steps(source, state): new sources come, gone ones go; changed ones keep their path.

        Sources that are there already or not at all change nothing, so a plan may be applied again. Only folders of
        these sources and of their tokens are written. If that ends between the two tables, recount() mends the numbers.
        """
        steps = stored(steps.filter("state in ('nuevo', 'eliminado') and source is not null").select("source", "state").distinct())
        known = stored(self.tokens.lookup(steps).select("source", "token")) if self.tokens.exists() else self.spark.createDataFrame([], "source string, token string")
        # A path without tokens is known by a row with none.
        came = steps.filter("state = 'nuevo'").join(known, "source", "left_anti").select("source", F.explode_outer(path_tokens(F.col("source"))).alias("token"), F.lit(1).alias("sign"))
        went = known.join(steps.filter("state = 'eliminado'"), "source", "left_semi").select("source", "token", F.lit(-1).alias("sign"))
        change = stored(came.unionByName(went))
        delta = stored(change.filter("token is not null").groupBy("token").agg(F.sum("sign").alias("n")).filter("n <> 0"))
        new = change.filter("sign = 1").select("source", "token")
        self.tokens.replace(change.filter("sign = -1").select("source"), None if new.isEmpty() else new)
        self.counts.rewrite(delta, lambda there: (delta if there is None else there.unionByName(delta)).groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0"))

    def recount(self) -> None:
        """The numbers anew, from all tokens."""
        own = stored(self.read().groupBy("token").agg(F.count(F.lit(1)).alias("n")))
        self.counts.replace(self.numbers().select("token"), own)
