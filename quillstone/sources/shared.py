"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders that open scratch() blocks have seen made, one list a block; every thread has its own blocks.
_SEEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started; safe to repeat."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a temporary one in local mode;
    on a cluster a folder of the driver's machine would lose data without a word, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="quillstone-"))
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for seen in _SEEN.get():
        seen.append(path)
    return path


def written(df: DataFrame, what: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df through Parquet: cuts lineage and survives lost executors. instead_of: a written table that
    nothing else reads any more; its folder goes."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if instead_of is not None and getattr(instead_of, "written_to", None):
        remove(df.sparkSession, instead_of.written_to)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the folders that this thread made inside, but for those that the block takes out of the list."""
    seen: list[str] = []
    opened = _SEEN.set((*_SEEN.get(), seen))
    try:
        yield seen
    finally:
        _SEEN.reset(opened)
        for path in seen:
            remove(spark, path)
