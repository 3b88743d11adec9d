"""Exact deduplication as a stateful stream, in DataFrame functions alone.

Texts are equal when they are identical after lower-casing A-Z. An intake step appends a light
row for every document (digest, doc_id, and the file and row that hold its text) to a folder;
a stream over that folder keeps, for every digest and without expiry, the stable identifier
(the largest doc_id), the locator of its text and a count, in RocksDB on the executors' disks
with checkpoints in the shared folder. Hits, that is rows whose digest has others, are then
read once more, the located ones among them, and their full bytes compared; texts that share a
digest but differ are grouped by their bytes.

One plan serves all sizes. A filter of bounded size keeps what can't be a hit out of the
comparison, equal bytes collapse in the task that reads them, before the shuffle, and rows find
their digest's state by a join that leaves the rows of hot digests where they are.

Edge cases: a null text is empty, and all empty texts are equal; a null doc_id sorts below all
others; of rows with the same doc_id and text, one is kept; an empty table gives no rows; texts
of any length are compared whole; only the id and text columns are read, so further columns can
have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flagged, join_hot, located, lower_ascii, placed, shared_dir, table, without_rows, written

#: The state store. Without preallocation: that takes 4 MB of disk a state partition, whatever is in it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOCATOR = "doc_id long, path string, row long"
INTAKE = f"digest string, text_sha256 string, {LOCATOR}"
STATE = f"digest string, keep struct<{LOCATOR.replace(' ', ':').replace(',:', ',')}>, n long"


class DedupState:
    """The stream and its state in a folder; ingest() may be called again with more documents."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home

    def ingest(self, rows: DataFrame) -> None:
        """Appends intake rows and runs the stream over what is new."""
        rows.write.mode("append").parquet(f"{self.home}/intake")
        batches = f"{self.home}/state"

        def keep(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{batches}/batch={batch}")

        before = {k: self.spark.conf.get(k, None) for k in STORE}
        for k, v in STORE.items():
            self.spark.conf.set(k, v)
        try:
            stream = self.spark.readStream.schema(INTAKE).parquet(f"{self.home}/intake")
            state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
            query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.home}/stream").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(INTAKE).parquet(f"{self.home}/intake")

    def groups(self) -> DataFrame:
        """digest, keep and n as of the last batch that changed them."""
        none = self.spark.createDataFrame([], f"{STATE}, batch int")
        none.write.mode("overwrite").parquet(f"{self.home}/state/batch=-1")
        all_rows = self.spark.read.schema(f"{STATE}, batch int").parquet(f"{self.home}/state")
        if all_rows.where("batch > 0").select("batch").limit(1).count():
            last = F.max_by(F.struct("keep", "n"), "batch").alias("s")
            return all_rows.groupBy("digest").agg(last).select("digest", "s.keep", "s.n")
        return all_rows.select("digest", "keep", "n")


def unlike_digests(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests whose texts aren't all the same, by their full bytes. texts: digest, text."""
    hits = flagged(texts, groups.where("n > 1").select("digest"), ["digest"]).where("maybe").select("digest", "text").distinct()
    return hits.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and path and row of every row of docs.

    digest replaces SHA-256 as the state's key; whatever it collides on is told apart by bytes.
    """
    return grouped(located(docs, {"doc_id": id_col, "text": text_col}, "exact-documents"), digest)


def grouped(texts: DataFrame, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """exact_dedup of texts: doc_id, text, path, row."""
    texts = texts.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": lower_ascii(F.col("text").cast("string"))})
    sha = F.sha2(F.col("text").cast("binary"), 256)
    key = digest(F.col("text")).cast("string") if digest else sha
    state = DedupState(texts.sparkSession, shared_dir(texts.sparkSession, "exact"))
    state.ingest(texts.select(key.alias("digest"), sha.alias("text_sha256"), "doc_id", "path", "row"))
    groups, rows = state.groups(), state.rows()
    unlike = written(unlike_digests(texts.select(key.alias("digest"), "text"), groups), "exact-unlike")

    same = (F.col("path") == F.col("keep.path")) & (F.col("row") == F.col("keep.row"))
    out = [F.col("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), F.col("text_sha256"), F.col("path"), F.col("row")]
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    result = join_hot(rows, groups, "digest", "n", total).select("digest", *out)
    if not unlike.limit(1).count():
        return result.drop("digest")
    apart = texts.withColumn("digest", key).join(unlike, "digest", "left_semi")
    by_bytes = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "path", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    apart = apart.join(by_bytes, ["digest", "text"]).withColumn("text_sha256", sha).select(*out)
    return result.join(unlike, "digest", "left_anti").drop("digest").unionByName(apart)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns."""
    rows, names = placed(docs, "exact-documents")
    of = {k: F.col(f"c{names.index(c)}").alias(k) for k, c in (("doc_id", id_col), ("text", text_col))}
    found = grouped(rows.select(*of.values(), "path", "row"))
    dropped = written(found.where("not kept").select("path", "row"), "exact-dropped")
    return without_rows(rows, dropped).drop("path", "row").toDF(*names)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {
    "op1_exact_dedup": f"""
with t as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as x from documents),
g as (select *, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
  row_number() over (partition by x order by doc_id desc nulls last, rid desc) = 1 as kept from t)
select doc_id::bigint as doc_id, keep_id::bigint as keep_id, group_size::bigint as group_size, kept, sha256(x) as text_sha256 from g"""
}
