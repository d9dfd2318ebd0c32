import datetime
import math
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, np.ndarray, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime, datetime.date)):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check


@pytest.fixture()
def tables(spark, tmp_path):
    """Write DataFrames as the tables of a folder; copies of the given tables fill the rest, emptied."""

    def write(**given):
        for f in Path(SF).glob("*.parquet"):
            name = f.stem
            base = spark.read.parquet(str(f))
            df = given.get(name)
            (base.limit(0) if df is None else df).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
