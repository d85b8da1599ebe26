"""Features and targets."""

import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsignal.operators import features, target


@pytest.fixture
def panel(spark):
    data = [(e, datetime(2020, 1, d), x, y, "t") for e, d, x, y in [("a", 1, 10.0, 1), ("a", 2, 11.0, 0), ("a", 3, 9.9, 3), ("b", 1, 0.0, 4), ("b", 2, 5.0, 5), ("b", 3, 5.0, 6)]]
    return spark.createDataFrame(data, "entity string, date timestamp, x double, y int, text string")


def column(df, c, *order):
    return [r[c] for r in df.orderBy(*(order or ("entity", "date"))).collect()]


def test_ratios(spark, panel):
    out, log = features.generate_ratio_features(panel, ["x", "y"])
    assert column(out, "x_div_y_ratio") == [10.0, 1e60, pytest.approx(3.3), 0.0, 1.0, pytest.approx(5 / 6)]
    assert log.count() == 1
    with pytest.raises(ValueError):
        features.generate_ratio_features(panel, ["x"])


def test_changes(spark, panel):
    out, _ = features.generate_temporal_pct_change(panel, ["x"], ["entity"], "date")
    got = column(out, "x_pctchange")
    assert got[0] is None and got[1] == pytest.approx(0.1) and got[2] == pytest.approx(-0.1) and got[3] is None and got[4] == math.inf and got[5] == 0
    trends = features.generate_and_encode_temporal_trends(panel, [1, 2], ["x"], ["entity"], "date")
    assert column(trends, "x_combined_trend") == ["no_data_no_data", "no_data_up", "flat_down", "no_data_no_data", "no_data_up", "up_flat"]
    assert "x_1_trend" in features.generate_and_encode_temporal_trends(panel, [1], ["x"], ["entity"], "date", return_mode="encoded_and_combined").columns
    assert "x_pctchange_1" in features.generate_and_encode_temporal_trends(panel, [1], ["x"], ["entity"], "date", return_mode="raw_and_combined").columns


def test_dates(spark):
    days = pd.to_datetime(["2020-01-01", "2020-02-29", "2021-12-31", "2021-03-31", "2022-01-02", "2020-07-01"])
    df = spark.createDataFrame([(i, d.to_pydatetime()) for i, d in enumerate(days)], "i int, d timestamp")
    out = features.extract_date_features(df, "d").orderBy("i").toPandas()
    assert out.dt_year.tolist() == days.year.astype(str).tolist() and out.dt_quarter.tolist() == days.quarter.astype(str).tolist()
    assert out.dt_week.tolist() == days.isocalendar().week.astype(str).tolist() and out.dt_weekday.tolist() == days.weekday.astype(str).tolist()
    for flag in ("month", "quarter", "year"):
        for end in ("start", "end"):
            assert out[f"dt_is_{flag}_{end}"].tolist() == getattr(days, f"is_{flag}_{end}").astype(int).tolist()


def test_bins(spark):
    df = spark.createDataFrame([(i, float(x) if x is not None else None) for i, x in enumerate([1, 2, 3, 4, 5, 6, 7, None, 100])], "i int, x double")
    labels = ["q1", "q2", "q3", "q4"]
    got = [r["x"] for r in features.bin_columns_flexible(df, ["x"], quantile_labels=labels)[0].orderBy("i").collect()]
    want = pd.qcut(pd.Series([1, 2, 3, 4, 5, 6, 7, None, 100]), [0, 0.25, 0.5, 0.75, 1], labels=labels).astype(object).where(lambda s: s.notna(), "no_data").tolist()
    assert got == want
    unnamed = [r["x"] for r in features.bin_columns_flexible(df, ["x"], quantile_labels=[])[0].orderBy("i").collect()]
    assert unnamed[0].startswith("[1.000, ") and unnamed[7] == "no_data" and "no_data" not in unnamed[:7]
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert {r["x"] for r in features.bin_columns_flexible(flat, ["x"], quantile_labels=labels)[0].collect()} == {"no_data"}


def test_sweep_and_one_hot(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 2 + ["b"] + ["c"] * 2 + ["d"] + ["e"] * 4] + [(None,)], "v string")
    swept = sorted(str(r["v"]) for r in features.sweep_low_count_bins(df, ["v"], 2, reserved_labels=["d"])[0].collect())
    assert swept == sorted(["None", "a", "a", "c", "c", "d", "e", "e", "e", "e", "others"])
    wide = features.one_hot_encode_features(df.withColumn("n", F.lit(1)))
    assert wide.columns == ["n", "v=a", "v=b", "v=c", "v=d", "v=e"] and wide.filter("`v=e`").count() == 4
    odd = spark.createDataFrame([("x.y (1, 2]", "no_data")], "`a=b` string, c string")
    assert features.one_hot_encode_features(odd, drop_no_data_columns=True).columns == ["a=b=x.y (1, 2]"]
    assert [r["items"] for r in features.items(odd, ["a=b", "c"]).collect()] == [["a=b=x.y (1, 2]"]]
    with pytest.raises(ValueError):
        features.one_hot_encode_features(df, max_columns=2)
    kept = features.drop_no_data_patterns(spark.createDataFrame([(1, 1)], "`x_combined_trend=no_data_up` int, `x_combined_trend=up_up` int"))
    assert kept.columns == ["x_combined_trend=up_up"]


def test_readiness(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.5, None), ("a", 1, 0, 1.0, 1)], "id string, d int, f int, g double, h int")
    report = features.validate_pipeline_input(df, ["id"], "d")
    assert not report["ready"] and not report["unique_keys"] and report["non_binary_features"] == ["g"] and report["features_with_nulls"] == ["h"]
    assert features.validate_pipeline_input(df, ["who"], "d")["missing_columns"] == ["who"]


@pytest.fixture
def prices(spark):
    data = [(t, datetime(2020, 1, d), p) for t, ps in {"A": [100.0, 110.0, 99.0, 120.0, 130.0], "B": [10.0, 20.0, 10.0]}.items() for d, p in enumerate(ps, 1)]
    return spark.createDataFrame(data, "ticker string, date timestamp, adj_close double")


def test_forward_returns(spark, prices):
    args = dict(n_periods=2, id_cols=["ticker"])
    got = column(target.compute_forward_return(prices, **args), "forward_return", "ticker", "date")
    assert got == pytest.approx([-0.01, 120 / 110 - 1, 130 / 99 - 1, 0.0])
    logs = column(target.compute_forward_return(prices, return_mode="log_return", **args), "forward_return", "ticker", "date")
    assert logs == pytest.approx([math.log(x + 1) for x in got])
    smooth = column(target.compute_forward_return(prices, return_mode="smoothed", smoothing_method="max", **args), "forward_return", "ticker", "date")
    assert smooth == pytest.approx([0.1, 0.0, 120 / 99 - 1, 130 / 120 - 1, 1.0, 0.0])  # no window runs into the next id
    medians = column(target.compute_forward_return(prices, return_mode="smoothed", **args), "forward_return", "ticker", "date")
    assert medians[0] == pytest.approx(0.05)
    vol = target.compute_forward_return(prices, return_mode="vol_adjusted", vol_window=3, **args)
    assert vol.filter("ticker = 'A'").count() == 2  # a deviation takes two returns
    for bad in (dict(n_periods=0), dict(return_mode="x"), dict(return_mode="vol_adjusted"), dict(return_mode="smoothed", smoothing_method="x"), dict(price_col="nope")):
        with pytest.raises(ValueError):
            target.compute_forward_return(prices, **({"n_periods": 2} | bad))


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, "3 days"])
def test_asof_equals_pandas(spark, direction, tolerance):
    import random

    r = random.Random(4)
    day = lambda: datetime(2020, 1, r.randint(1, 28))
    left = pd.DataFrame([(r.choice("ab"), day(), i) for i in range(40)], columns=["id", "d", "i"]).sort_values("d")
    right = pd.DataFrame([(r.choice("ab"), day(), float(i)) for i in range(15)], columns=["id", "rd", "v"]).drop_duplicates(["id", "rd"]).sort_values("rd")
    want = pd.merge_asof(left, right, left_on="d", right_on="rd", by="id", direction=direction, tolerance=pd.Timedelta(tolerance) if tolerance else None)
    got = target.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "d", "rd", ["id"], direction, tolerance)
    assert {x["i"]: x["v"] for x in got.collect()} == {x.i: (None if pd.isna(x.v) else x.v) for x in want.itertuples()}


def test_merge(spark):
    feats = spark.createDataFrame([("abc", "2020-01-02", 1.0), ("xyz", "2020-01-05", 2.0), (None, "2020-01-05", 3.0)], "ticker string, fd string, v double")
    rets = spark.createDataFrame([("ABC", "2020-01-02", 0.1), ("XYZ", "2020-01-09", 0.2)], "ticker string, rd string, r double")
    args = dict(id_cols=["ticker"], feature_date_col="fd", returns_date_col="rd")
    merged = target.merge_features_with_returns(feats, rets, **args)
    assert sorted((str(x["ticker"]), x["r"]) for x in merged.collect()) == [("ABC", 0.1), ("None", None), ("XYZ", 0.2)]
    assert {x["r"] for x in target.merge_features_with_returns(feats, rets, id_case="original", **args).collect()} == {None}
    totals = target.summarize_merge(merged, ["ticker"], "rd", "fd", "r")["totals"].first()
    assert tuple(totals) == (3, 2, 1)
    with pytest.raises(ValueError):
        target.merge_features_with_returns(feats.withColumn("fd", F.lit("soon")), rets, **args)


def test_target_bins(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([-1.0, 0.0, 0.04, 2.0, None])], "i int, r double")
    got = lambda out: [x["r"] for x in out.orderBy("i").collect()]
    assert got(target.bin_target_column(df, [0.0], ["neg", "pos"], "binary", "r")) == ["neg", "neg", "pos", "pos", "neg"]
    assert got(target.bin_target_column(df, [-math.inf, 0, 0.05, math.inf], ["d", "s", "u"], "custom", "r")) == ["d", "d", "s", "u", "no_data"]
    assert got(target.bin_target_column(df, [0, 1], ["a", "b"], "custom", "r")) == ["no_data"] * 5
    assert got(target.bin_target_column(df, [0, 0.5, 1], ["lo", "hi"], "quantile", "r")) == ["lo", "lo", "hi", "hi", "no_data"]
    assert not target.validate_target_pipeline_input(df.withColumn("d", F.lit(1)), ["i"], "d", "r", max_classes=3)["target_ok"]
