import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL in DuckDB over the tables of a folder."""

    def run(sql: str, folder: str = SMALL):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for path in glob.glob(f"{folder}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
        return con.sql(sql).fetchall(), con.sql(sql).columns

    return run


def normal(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame has the rows of (rows, columns), in any order."""

    def check(df, expected):
        rows, columns = expected
        order = sorted(columns)
        assert sorted(df.columns) == order
        got = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=repr)
        want = sorted((tuple(normal(dict(zip(columns, r))[c]) for c in order) for r in rows), key=repr)
        assert got == want

    return check
