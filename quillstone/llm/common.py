"""What several operators share: tables, the shared folder, places of rows, skewed joins, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.shared import remove, scratch, shared_dir, written

__all__ = ["arrow_batches", "changes", "flagged", "join_hot", "let", "located", "lower_ascii", "picked", "placed", "prepare", "remove", "scratch", "shared_dir", "table", "whole_runs", "without_rows", "written"]

ROOT = str(Path(__file__).resolve().parents[2])
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and bytes of an Arrow batch: a worker holds a few of them at a time.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: A filter of keys has at most so many words of 64 bits (some 40 bytes each once broadcast), and a key sets so many bits of one.
FILTER_WORDS, FILTER_BITS = 1 << 20, 3
#: A key is hot if it has more than one in so many of all rows, so there are fewer hot keys than that.
HOT_SHARE = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches and lets Python workers import this package; safe to repeat.
    The settings stay, as plans that are returned run later."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 8192) -> Iterator[None]:
    """Arrow batches of at most so many rows and BATCH_BYTES in plans that run inside; the caller's settings come back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    prepare(spark)
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def picked(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of docs under other names (new: old). Goes by place, so further columns can have any names."""
    names = docs.columns
    return docs.toDF(*[f"c{k}" for k in range(len(names))]).select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: optimizer rules don't inline lambda variables."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- places of rows -----------------------------------------------------------------------


def placed(docs: DataFrame, what: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... instead of its own names, and path and row, which tell its rows
    apart; and its names. What doesn't come straight from files is written first."""
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]  # names of the input can't clash with any of ours
    inner = docs.toDF(*own)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")]
    try:
        if "_metadata" in names:
            raise AnalysisException("a column of the documents has this name")
        return inner.select(*own, *place), names
    except AnalysisException:
        return written(inner, what).select(*own, *place), names


def located(docs: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    """Columns of docs under other names (new: old), with path and row."""
    inner, names = placed(docs, what)
    return inner.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()], "path", "row")


def flagged(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows with `maybe`: false only where a row's key isn't among keys.

    The keys set bits of a filter that has at most FILTER_WORDS words whatever their number, so it
    can be broadcast. The more keys beyond some 4 a word, the more rows are flagged in vain: that
    costs work, never a result.
    """
    words = FILTER_WORDS
    n = keys.count()
    while words > 1024 and words > n // 2:
        words //= 2
    bit = lambda h, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    word = F.xxhash64(*on).bitwiseAND(F.lit(words - 1).cast("long"))
    second = F.xxhash64(*on, F.lit(1))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [bit(second, k) for k in range(FILTER_BITS)])
    bits = written(keys.select(word.alias("f_word"), mask.alias("f_mask")).groupBy("f_word").agg(F.bit_or("f_mask").alias("f_bits")), "filter")
    out = rows.withColumns({"f_word": word, "f_mask": mask}).join(F.broadcast(bits), "f_word", "left")
    return out.withColumn("maybe", F.coalesce(F.col("f_bits").bitwiseAND(F.col("f_mask")) == F.col("f_mask"), F.lit(False))).drop("f_word", "f_mask", "f_bits")


def without_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows but for those whose path and row are in dropped. Only rows that the filter flags are
    shuffled, which are little more than those that go."""
    of = flagged(rows, dropped, ["path", "row"])
    stay = of.where(~F.col("maybe")).drop("maybe")
    doubtful = of.where("maybe").drop("maybe").join(dropped, ["path", "row"], "left_anti")
    return stay.unionByName(doubtful.select(*stay.columns))


def join_hot(rows: DataFrame, keys: DataFrame, on: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keys (one row a key, n: how many of all total rows have it). Hot keys are
    fewer than HOT_SHARE, so their rows are joined where they are; only those of other keys are shuffled."""
    most = total // HOT_SHARE
    hot = F.broadcast(keys.where(F.col(n) > most))
    cool = rows.join(hot.select(on), on, "left_anti").join(keys.where(F.col(n) <= most), on, how)
    out = rows.join(hot, on)
    return out.unionByName(cool.select(*out.columns))


# --- sorted Arrow batches ------------------------------------------------------------------


def changes(b: pa.RecordBatch, keys: list[int], before: pa.RecordBatch | None) -> np.ndarray:
    """Where rows of a sorted batch differ in key columns from the row before; before: the batch that ends there. Nulls are all different."""
    out = np.zeros(b.num_rows, dtype=bool)
    out[0] = before is None or any(b.column(k)[0] != before.column(k)[before.num_rows - 1] for k in keys)
    for k in keys:
        c = b.column(k)
        out[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches dealt anew so that no run of equal keys is cut, with the places where runs start.
    Holds one batch and one run at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        b = pa.concat_batches(held)
        return b, np.flatnonzero(changes(b, keys, None))

    for b in batches:
        if not b.num_rows:
            continue
        at = np.flatnonzero(changes(b, keys, held[-1] if held else None))
        if len(at):
            if at[-1]:
                held.append(b.slice(0, at[-1]))
            if held:
                yield joined()
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        yield joined()
