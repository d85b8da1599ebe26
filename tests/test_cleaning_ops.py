"""Types, missing data, scaling, pruning."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsignal.operators import missing, prune, scale, types
from tabsignal.functions.scalar import NULL_TOKENS, probit, ratio


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([" Ab\tC ", "N/A", "x\ny", "", "None", "nan", "keep", None, " - "])], "i int, s string")
    assert [r[1] for r in rows(types.clean_raw_strings(df, ["s", "i"]), "i")] == ["abc", None, "xy", None, None, None, "keep", None, None]
    assert len(NULL_TOKENS) == 12


def test_numbers_booleans_dates(spark):
    df = spark.createDataFrame([("1", "1.5", "x", "Yes", "2020-01-02 03:04:05", "a"), ("2", "z", "y", " no ", "2020/01/03", "B "), ("3", "2", "z", "maybe", "never", None)], "a string, b string, c string, d string, e string, f string")
    out = types.coerce_numeric_columns(df, ["a", "b", "c"])
    assert dict(out.dtypes)["a"] == "bigint" and dict(out.dtypes)["b"] == "double" and dict(out.dtypes)["c"] == "string"
    assert rows(out.select("a", "b"), "a") == [(1, 1.5), (2, None), (3, 2.0)]
    assert rows(types.coerce_boolean_columns(df, ["d", "e"]).select("a", "d", "e"), "a") == [("1", True, "2020-01-02 03:04:05"), ("2", False, "2020/01/03"), ("3", None, "never")]
    day = types.parse_datetime_column(df, "e", floor_to_day=True).orderBy("a").select(F.date_format("e", "yyyy-MM-dd HH:mm"))
    assert [r[0] for r in day.collect()] == ["2020-01-02 00:00", "2020-01-03 00:00", None]
    assert rows(types.coerce_categorical_columns(df, ["f"]).select("a", "f"), "a") == [("1", "a"), ("2", "b"), ("3", None)]
    assert rows(types.coerce_categorical_columns(df, ["f"], nan_category=True).select("f"), "f")[-1] == ("nan",)
    with pytest.raises(ValueError):
        types.coerce_numeric_columns(df, ["nope"])


def test_detection(spark):
    df = spark.createDataFrame([("1", "2020-01-01", "t", "a", None), ("2", "2020-02-01", "f", "b", None), ("x", "n/a", "yes", "c", None), ("4", "2020-03-01", "no", "d", None), ("5", "2021-01-01", "t", "e", None)], "n string, d string, b string, c string, v string")
    assert types.detect_column_types(df) == {"numeric": ["n"], "datetime": ["d"], "boolean": ["b"], "categorical": ["c", "v"]}
    assert types.detect_column_types(df, numeric_threshold=0.9)["categorical"] == ["n", "c", "v"]
    out, log = types.apply_column_type_cleaning(df)
    assert dict(out.dtypes)["n"] == "double" and dict(out.dtypes)["d"] == "timestamp" and dict(out.dtypes)["b"] == "boolean"
    assert {r["column_name"]: r["changed"] for r in log.collect()}["c"] is False


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([("a", 1, 1.0, "p"), ("a", 2, None, None), ("a", 3, 3.0, "q"), ("a", 4, 8.0, "q"), ("b", 1, None, None), ("b", 2, None, None), ("c", 1, 5.0, "z"), (None, 1, None, None)], "id string, t int, x double, k string")


def test_imputation(spark, panel):
    filled, log = missing.impute_numeric_per_group(panel, ["id"], ["x"])
    assert [r["x"] for r in filled.orderBy("id", "t").collect()] == [None, 1.0, 3.0, 3.0, 8.0, None, None, 5.0]
    assert rows(log.select("id", "count_filled", "percent_filled", "fill_successful"), "id") == [("a", 1, 0.25, True), ("b", 2, 1.0, False)]
    assert [r["x"] for r in missing.impute_numeric_per_group(panel, ["id"], ["x"], "mean")[0].filter("id = 'a'").orderBy("t").collect()] == [1.0, 4.0, 3.0, 8.0]
    moded, _ = missing.fill_categorical_per_group(panel, ["id"], ["k"])
    assert [r["k"] for r in moded.filter("id = 'a'").orderBy("t").collect()] == ["p", "q", "q", "q"]
    tie = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", None)], "id string, k string")
    assert {r["k"] for r in missing.fill_categorical_per_group(tie, ["id"], ["k"])[0].collect()} == {"z", "b"}
    with pytest.raises(ValueError):
        missing.impute_numeric_per_group(panel, ["id"], ["x"], "magic")


def test_masking_and_dropping(spark, panel):
    filled, log = missing.impute_numeric_per_group(panel, ["id"], ["x"])
    masked = missing.mask_high_imputation(filled, [log.withColumnRenamed("percent_filled", "percent")], ["id"], 0.2)
    assert [r["x"] for r in masked.filter("id = 'a'").collect()] == [None] * 4
    assert [r["x"] for r in masked.filter("id = 'c'").collect()] == [5.0]
    gaps = spark.createDataFrame([(None, None, 1), (1.0, None, 2), (None, None, None)], "a double, b double, c int")
    out, _ = missing.drop_high_missingness(gaps, 0.9, 0.9)
    assert out.columns == ["a", "c"] and out.count() == 2
    for bad in (0, 1, 2):
        with pytest.raises(ValueError):
            missing.drop_high_missingness(gaps, bad, 0.5)
    both, logs = missing.handle_missing_data(panel, id_cols=["id"], exclude=["t"])
    assert set(logs) == {"drop_high_missingness", "impute_numeric", "impute_categorical"} and both.count() == 8


@pytest.fixture
def values(spark):
    data = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 100.0), ("b", 1, 4.0), ("b", 2, 5.0), ("b", 3, 4.0), ("c", 1, 7.0), ("d", 1, 3.0), ("d", 2, 3.0), ("d", 3, None)]
    return spark.createDataFrame(data, "id string, t int, x double"), pd.DataFrame(data, columns=["id", "t", "x"])


@pytest.mark.parametrize("grouping", ["none", "ids", "datetime", "datetime+ids"])
def test_scalers_by_group(spark, values, grouping):
    df, p = values
    p = p.sort_values(["t", "id"]).reset_index(drop=True)
    g = {"none": pd.Series("all", p.index), "ids": p.id, "datetime": p.index // 3, "datetime+ids": p.id + (p.groupby("id").cumcount() // 2).astype(str)}[grouping]
    by = p.groupby(g).x
    args = dict(grouping=grouping, id_cols=["id"], date_col="t", n_datetime_units=2 if "+" in grouping else 3)
    want = {
        "z": (p.x - by.transform("mean")) / by.transform(lambda s: s.std(ddof=0)).replace(0, float("nan")),
        "w": p.x.clip(by.transform(lambda s: s.quantile(0.1)), by.transform(lambda s: s.quantile(0.9))),
        "r": ((p.x - by.transform("median")) / by.transform(lambda s: s.quantile(0.75) - s.quantile(0.25)).replace(0, float("nan"))).where(by.transform("count") >= 2),
        "k": ((by.rank() - 1) / (by.transform("count") - 1)).where(by.transform("count") >= 2),
        "u": p.x / by.transform(lambda s: math.sqrt((s * s).sum())).replace(0, float("nan")),
    }
    got = {
        "z": scale.zscore_flexible(df, ["x"], **args)[0],
        "w": scale.winsorize_flexible(df, ["x"], lower_quantile=0.1, upper_quantile=0.9, **args)[0],
        "r": scale.robust_scale_flexible(df, ["x"], **args)[0],
        "k": scale.quantile_rank_transform_flexible(df, ["x"], "rank", **args)[0],
        "u": scale.unit_vector_scale_flexible(df, ["x"], **args)[0],
    }
    for name, out in got.items():
        assert out.columns == df.columns
        mine = [r["x"] for r in out.orderBy("t", "id").collect()]
        theirs = [None if pd.isna(v) else float(v) for v in want[name]]
        assert all(close(a, b) for a, b in zip(mine, theirs)), (name, mine, theirs)


def test_scaler_logs_and_errors(spark, values):
    df, _ = values
    assert rows(scale.winsorize_flexible(df, ["x"], lower_quantile=0.1, upper_quantile=0.9)[1].select("column", "before"), "before")[-1] == ("x", 100.0)
    assert {r["group"]: r["mean"] for r in scale.zscore_flexible(df, ["x"], "ids", ["id"])[1].collect()}["b"] == pytest.approx(13 / 3)
    with pytest.raises(ValueError):
        scale.zscore_flexible(df, ["x"], "weird")
    with pytest.raises(ValueError):
        scale.normalize_features(df, "weird")
    assert {r["id"] for r in scale.normalize_features(df.withColumn("id", F.lit(5)), id_cols=["id"], date_col="t")[0].collect()} == {5}


def test_custom_apply(spark, values):
    df, _ = values
    out = scale.custom_apply_flexible(df.filter("x IS NOT NULL"), ["x"], lambda s, by: s - by, "ids", ["id"], func_kwargs={"by": 1})
    assert sorted(r["x"] for r in out.collect()) == [0.0, 1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 6.0, 99.0]
    with pytest.raises(Exception, match="values for"):
        scale.custom_apply_flexible(df, ["x"], lambda s: s[:0]).collect()
    with pytest.raises(Exception, match="failed on column"):
        scale.custom_apply_flexible(df, ["x"], lambda s: 1 / 0).collect()


def test_probit_and_ratio(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.001, 0.02, 0.025, 0.3, 0.5, 0.7, 0.975, 0.999, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(probit(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [1e60, -1e60, None, 0.25]


def test_pruning(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, float(i % 3), "s") for i in range(12)], "x double, y double, c double, z double, s string")
    out, log = prune.drop_low_variance_columns(df)
    assert out.columns == ["x", "y", "z", "s"] and {r["column"] for r in log.collect() if r["dropped"]} == {"c"}
    assert prune.drop_highly_correlated_columns(out)[0].columns == ["x", "z", "s"]
    both, logs = prune.handle_outliers_and_redundancy(df, to_winsorize=False)  # the column list is made anew after each step
    assert both.columns == ["x", "z", "s"] and set(logs) == {"low_variance", "high_correlation"}
    with pytest.raises(ValueError):
        prune.drop_low_variance_columns(df.select("s"))
    summary = prune.generate_data_summary(df, high_cardinality_threshold=1)
    assert summary["shape"] == (12, 5) and summary["constant_columns"] == ["c", "s"] and summary["categorical_summary"]["s"] == {"mode": "s", "freq": 12}


def test_many_correlations_are_counted_in_chunks(spark, monkeypatch):
    r = random.Random(3)
    df = spark.createDataFrame([[r.gauss(0, 1) for _ in range(5)] for _ in range(60)], [f"c{i}" for i in range(5)])
    want = sorted(map(tuple, prune.correlations(df, df.columns).collect()))
    monkeypatch.setattr(prune, "CHUNK", 3)
    got = sorted(map(tuple, prune.correlations(df, df.columns).collect()))
    assert len(got) == 10 and [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, t int, x double, k string")
    assert scale.zscore_flexible(empty, ["x"], "datetime", ["id"], "t", 3)[0].count() == 0
    assert missing.handle_missing_data(empty, id_cols=["id"])[0].count() == 0
    assert types.detect_column_types(empty)["categorical"] == ["id", "t", "x", "k"]


@pytest.mark.parametrize("shares", [(0.0, 0.5, 1.0), (0.013, 0.25, 0.77)])
def test_spread_quantiles_are_exact(spark, monkeypatch, shares):
    from tabsignal.operators import grouping

    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 1.0, 2.5, r.gauss(0, 9)])) for _ in range(900)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "_group string, x double").repartition(5)
    want = {x["_group"]: x["_q0"] for x in grouping.group_quantiles(df, ["x"], shares).collect()}
    monkeypatch.setattr(grouping, "AGGREGATED_ROWS", 0)
    got = {x["_group"]: x["_q0"] for x in grouping.group_quantiles(df, ["x"], shares).collect()}
    assert set(got) == set(want) and got.pop("c") is None and want.pop("c") is None
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_row_numbers_of_texts_and_constants_are_spread(spark):
    from tabsignal.operators import grouping

    df = spark.createDataFrame([("same", f"t{i:04d}") for i in range(400)], "k string, t string").repartition(3)
    numbered = grouping.global_row_number(df, ["k", "t"], "n")
    assert {x["t"]: x["n"] for x in numbered.collect()} == {f"t{i:04d}": i for i in range(400)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        equal = spark.range(4000).selectExpr("1 AS a")
        parts = grouping.ranged(equal.withColumn("_tie", F.monotonically_increasing_id()), [F.col("a").asc(), F.col("_tie").asc()], "test").groupBy("_part").count().collect()
        assert len(parts) > 2 and max(p["count"] for p in parts) < 2500
        assert sorted(x["n"] for x in grouping.global_row_number(equal, ["a"], "n").collect()) == list(range(4000))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
