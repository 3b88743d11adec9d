import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df) -> list[tuple]:
    """Rows of a Spark or DuckDB result, columns by name, in a comparable order."""
    if hasattr(df, "toPandas"):
        cols = sorted(df.columns)
        data = [tuple(r[c] for c in cols) for r in df.collect()]
    else:
        names = df.columns
        order = sorted(range(len(names)), key=lambda i: names[i])
        data = [tuple(r[i] for i in order) for r in df.fetchall()]
    return sorted(data, key=lambda r: tuple((x is not None, str(x)) for x in r))
