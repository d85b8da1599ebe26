"""Queries against their SQL on small tables with rows that the given tables hold few of."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def against_sql(spark, folder, name, **tables):
    """The query's rows and those of its SQL, over tables given as DataFrames."""
    con = duckdb.connect()
    for t, df in tables.items():
        path = f"{folder}/{t}.parquet"
        df.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    out = __spark_entry__.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in out.columns)
    want = con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return _rows(out), sorted(want, key=str)


def zeros(spark):
    """Two users whose values are 0 now and then, twice in a row too."""
    values = [3.0, 0.0, 4.0, 0.0, 0.0, 5.0, 5.0, None, 0.0, 2.0]
    return spark.createDataFrame([(10 * u + i, datetime(2024, 1, 1) + timedelta(hours=i), u, "view", v) for u in range(2) for i, v in enumerate(values)], EVENTS)


def test_pct_change_against_zero(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "pct_change", events=zeros(spark))
    assert got == want and any(r[1] is None for r in want)


def test_trends_against_zero(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "trend_patterns", events=zeros(spark))
    assert got == want and any(r[1].endswith("no_data") for r in want)


def test_engineered_features_against_zero(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "engineer_features", events=zeros(spark))
    assert got == want and any(r[2] is None for r in want)


def test_target_of_prices_of_zero(spark, tmp_path):
    at = lambda i: datetime(2024, 1, 1) + timedelta(hours=i)
    views = [(1, 4.0), (3, 0.0), (5, 3.0), (7, None), (9, 2.0), (11, 0.0), (13, 0.0), (15, 8.0), (17, 4.0)]
    rows = [(i, at(i), 1, "view", v) for i, v in views] + [(i, at(i), 1, "click", 1.0) for i in range(0, 20, 2)]
    got, want = against_sql(spark, tmp_path, "target_chain", events=spark.createDataFrame(rows, EVENTS))
    assert got == want and len(want) == 6
