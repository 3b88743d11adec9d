"""Table store: appends, selections, upserts, deletions and JSON in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 20 * 1024 * 1024


def read_files(spark: SparkSession, path: str, suffix: str = ".pdf", max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """Uploaded files of one kind and a bounded size: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).where(F.col("length") <= max_bytes).select("path", "length", "content")


def gate(name: Column, size: Column, suffix: str = ".pdf", max_bytes: int = MAX_UPLOAD) -> Column:
    """`ok`, or why an upload is refused."""
    return F.when(~F.lower(name).endswith(suffix), "kind").when(size > max_bytes, "size").otherwise("ok")


def read_material(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, whole or below `result`, with an explicit schema."""
    raw = spark.read.option("multiLine", True).schema(f"result struct<{schema}>, {', '.join(f.replace(':', ' ', 1) for f in schema.split(','))}").json(path)
    names = [f.split(":")[0].strip() for f in schema.split(",")]
    return raw.select(*[F.coalesce(F.col(f"result.{n}"), F.col(n)).alias(n) for n in names])


def with_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows without an id get a random one."""
    return rows.withColumn(id_col, F.coalesce(id_col, F.expr("uuid()")))


def select(rows: DataFrame, equal: dict, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that equal all given values (null equals null), ordered, so many at most."""
    out = rows.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in equal.items()], F.lit(True)))
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def select_or(primary: DataFrame, backup: DataFrame, equal: dict) -> DataFrame:
    """The primary's rows, or the backup's if the primary has none: an anti-join on whether any exists."""
    p, b = select(primary, equal), select(backup, equal)
    some = p.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    return p.unionByName(b.join(F.broadcast(some)).where("not some").drop("some"))


def delete(rows: DataFrame, equal: dict) -> DataFrame:
    """What a deletion by equality leaves."""
    gone = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in equal.items()], F.lit(True))
    return rows.where(~gone)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, the latest version of each key; new ones win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def cascade(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Children whose parent stays."""
    return children.join(gone.select(key), key, "left_anti")


def delete_tree(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """What is left of all tables once rows of the root and all that hangs on them are deleted, children of children included.

    parents: of every other table its parent, its own key column and the parent's; in any order. gone: key rows of the root
    that go, under the names of its columns. Children whose key is null hang on nothing and stay."""
    lost, left = {root: tables[root].join(gone, gone.columns, "left_semi")}, {root: tables[root].join(gone, gone.columns, "left_anti")}
    waiting = dict(parents)
    while waiting:
        ready = [t for t, (up, *_) in waiting.items() if up in lost]
        if not ready:
            raise ValueError(f"no way from {root} to {', '.join(sorted(waiting))}")
        for t in ready:
            up, own, theirs = waiting.pop(t)
            keys = lost[up].select(F.col(theirs).alias(own)).distinct()
            lost[t], left[t] = tables[t].join(keys, own, "left_semi"), tables[t].join(keys, own, "left_anti")
    return left


def bundle_json(rows: DataFrame, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row as JSON without its heavy columns."""
    kept = [c for c in sorted(rows.columns) if c not in drop]
    return rows.select(key, F.to_json(F.struct(*kept)).alias("bundle"))
