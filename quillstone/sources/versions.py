"""Results that are kept by the version of what they were made from, and rebuilt only where that has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.shared import shared_dir, written

VERSION = "owner string, n long, digest long, batch int"


class Versions:
    """Results of owners in a folder, each with the count and the content digest of the owner's inputs when it was built.

    Batches are only ever added; of an owner the last one counts, and a version with a null count has been invalidated.
    A lost driver can go on from the folder: pass it as home."""

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark, self.home = spark, home or shared_dir(spark, "versions")
        self.batch = self._last() + 1

    def _table(self) -> DataFrame:
        none = self.spark.createDataFrame([], VERSION)
        none.write.mode("ignore").parquet(f"{self.home}/versions")
        return self.spark.read.schema(VERSION).parquet(f"{self.home}/versions")

    def _last(self) -> int:
        return self._table().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def current(self) -> DataFrame:
        """owner, n, digest and batch of every owner's last version."""
        last = F.max_by(F.struct("n", "digest", "batch"), "batch").alias("v")
        return self._table().groupBy("owner").agg(last).select("owner", "v.*").where("n is not null")

    def _add(self, rows: DataFrame) -> None:
        rows.select("owner", "n", "digest", F.lit(self.batch).alias("batch")).write.mode("append").parquet(f"{self.home}/versions")
        self.batch += 1

    def get(self, inputs: DataFrame, build: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
        """The results of all owners of inputs, with built: whether this call made them. build gets the inputs of those
        owners whose count or content differs from their last version (of all, if forced) and returns rows with owner.

        inputs: owner and any columns, all of which make the content."""
        names = inputs.columns
        marked = inputs.withColumn("owner", F.col("owner").cast("string"))
        content = F.xxhash64(*[F.col(f"`{c}`") for c in names if c != "owner"]).alias("content")
        now = marked.select("owner", content).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("content").cast("decimal(38,0)")).alias("s"))
        now = written(now.select("owner", "n", F.xxhash64("s").alias("digest")), "versions-now")
        stale = written(now if force else now.join(self.current(), ["owner", "n", "digest"], "left_anti"), "versions-stale")
        number = self.batch
        if stale.limit(1).count():
            rows = build(marked.join(stale.select("owner"), "owner", "left_semi"))
            rows.write.mode("overwrite").parquet(f"{self.home}/results/batch={number}")
            self._add(stale)
        of = self.current().join(now.select("owner"), "owner", "left_semi").select("owner", "batch")
        results = self.spark.read.parquet(f"{self.home}/results")
        return results.join(of, ["owner", "batch"]).withColumn("built", F.col("batch") == number).drop("batch")

    def invalidate(self, owners: DataFrame) -> None:
        """The next get() rebuilds these. owners: owner."""
        gone = owners.select(F.col("owner").cast("string").alias("owner")).distinct()
        self._add(gone.select("owner", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("digest")))
