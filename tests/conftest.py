import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # the workers' too

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def _plain(v):
    import numpy as np
    import pandas as pd

    if isinstance(v, list | np.ndarray):
        return tuple(_plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and np.isnan(v)):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating):
        return f"{v + 0.0:.8g}"
    return str(v)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(_plain(v) for v in r) for r in pdf.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL at the smallest size."""

    def check(f, sql):
        assert rows_of(f(spark, SMALL).toPandas()) == rows_of(duck.execute(sql).fetchdf())

    return check
