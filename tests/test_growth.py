"""Steps whose work must not grow faster than the table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsignal.operators import miners, synth, types, validate


def test_copula_quantiles_come_from_ranks(spark):
    r = random.Random(1)
    values = [r.choice([1.0, 2.0, 2.5]) for _ in range(700)] + [r.gauss(0, 9) for _ in range(600)]
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "x double, k int")
    _made, marks = synth._copula(df, 10, 1)
    for c, data in (("x", values), ("k", [i % 7 for i in range(1300)])):
        assert marks[c] == pytest.approx(list(np.quantile(data, np.arange(1001) / 1000)))


def test_copula_mixes_numbers_and_texts(spark):
    df = spark.createDataFrame([(float(i % 50), "A" if i % 50 > 30 else "B") for i in range(2000)], "x double, t string")
    got = synth.generate_combined_synthetic_data(df, sdv_rows=3000).agg(F.avg("x"), F.avg(F.when(F.col("t") == "A", F.col("x")))).first()
    assert abs(got[0] - 24.5) < 2 and got[1] > 28


def test_shapes_keep_every_date(spark):
    r = random.Random(3)
    seeds = ["2024-01-31 03:04:05", "2024-01-31T03:04", "2024/02/29", "12/31/2023 10:11", "31-12-2023", "20240131", "20240131 01:02:03", "Jan 5, 2024", "march 05, 2024", "5 Sep 2024", "05-JUN-2024", "2024-07", "-2024-01-01", "00005 May 2024", "2024-01-31 03:04:05.25+0530", "12.5", "maybe"]
    texts = [*seeds, "+12024-01-01"]
    for _ in range(3000):
        t = list(r.choice([x for x in seeds if not x.startswith("20240131")]))
        for _ in range(r.randint(1, 2)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = r.choice(["", *"0123456789 -/:,.+TtZa"])
        if not re.search("[0-9]{6}", "".join(t)):  # such years are beyond a timestamp, and raise
            texts.append("".join(t))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tried = [F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in types.DATE_FORMATS]
    lost = df.filter(types.to_timestamp(F.col("t")).isNull() & F.coalesce(*tried).isNotNull())
    assert lost.collect() == []
    kept = F.coalesce(F.when(~F.trim("t").rlike(types.ISO_TIME), F.coalesce(*tried)))
    assert df.filter(kept.isNotNull() & (types.to_timestamp(F.col("t")) != kept)).collect() == []
    assert all(types._shape(f) for f in types.DATE_FORMATS)


def test_harmonic_numbers(spark):
    sizes = [1, 2, 99, 100, 101, 1000, 250_000, 3_000_000_000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").orderBy("n").select(validate.harmonic(F.col("n"))).collect()]
    assert got[:-1] == pytest.approx([float(np.sum(1 / np.arange(1, n + 1))) for n in sizes[:-1]], rel=1e-14)
    assert got[-1] == pytest.approx(np.log(3e9) + np.euler_gamma, rel=1e-10)


def test_trees_learn_from_different_rows(spark, monkeypatch):
    rows = [(i % 2, i // 2 % 2, "y" if i % 2 and i // 2 % 2 or i % 16 == 0 else "n") for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, b int, t string")
    sizes, plain = [], miners._vectors
    monkeypatch.setattr(miners, "_vectors", lambda *x: sizes.append(plain(*x).count()) or plain(*x))
    assert miners.mine_rulefit(df, "t") and miners.perform_cart(df, "t", 3, min_samples_leaf=900)
    assert max(sizes) <= 8
    assert miners.perform_cart(df, "t", 3, min_samples_leaf=2001) == []


def test_frequent_sets_of_counted_baskets(spark):
    from itertools import combinations

    r = random.Random(5)
    baskets = [sorted(x for x in "abcdef" if r.random() < 0.5) for _ in range(60)]
    df = spark.createDataFrame([(b, i % 7 + 1) for i, b in enumerate(baskets)], "items array<string>, n long")
    want = {}
    for i, b in enumerate(baskets):
        for k in range(1, 7):
            for c in combinations(b, k):
                want[c] = want.get(c, 0) + i % 7 + 1
    got = {tuple(sorted(x["items"])): x["freq"] for x in miners._frequent_sets(df, 20).collect()}
    assert got == {c: n for c, n in want.items() if n >= 20}


def test_a_sample_orders_few_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, i // 2 % 3 > 0, "rare" if i % 500 == 0 else "y" if i % 3 else "n") for i in range(6000)], "a int, b boolean, t string")
    sizes, plain = [], miners.global_row_number
    monkeypatch.setattr(miners, "global_row_number", lambda d, *x: sizes.append(d.count()) or plain(d, *x))

    def draw(lowest):
        monkeypatch.setattr(miners, "LOWEST", lowest, raising=False)
        out = miners.prepare_dataframe_for_mining(df, "d", [], [], "t", sample_size=600)[0]
        return sorted(map(tuple, out.groupBy("a", "b", "t").count().collect()))

    want = draw(1e9)
    assert draw(1.5) == draw(0.5) == want and sum(r[-1] for r in want) == 600
    assert sizes[0] == 6000 and sizes[1] < 1200 and 600 <= sizes[2] <= 6000


def test_columns_without_nulls_are_not_imputed(spark, monkeypatch):
    from tabsignal.operators import missing

    asked, plain = [], missing.group_quantiles
    monkeypatch.setattr(missing, "group_quantiles", lambda d, columns, *x, **y: asked.append(list(columns)) or plain(d, columns, *x, **y))
    whole = spark.createDataFrame([("a", 1, 2.0, "u"), ("a", 2, 3.0, "v"), ("b", 3, 4.0, "w")], "id string, n int, x double, k string")
    out, logs = missing.handle_missing_data(whole, id_cols=["id"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect())) and dict(out.dtypes)["n"] == "double"
    assert [logs[k].collect() for k in ("impute_numeric", "impute_categorical")] == [[], []] and asked == []
    assert logs["impute_numeric"].columns == ["id", "column", "count_filled", "percent_filled", "fill_value", "fill_successful"]
    holed = spark.createDataFrame([("a", 1, None, "u"), ("a", 2, 3.0, "v"), ("b", 3, 4.0, None)], "id string, n int, x double, k string")
    filled, log = missing.impute_numeric_per_group(holed, ["id"], ["n", "x"])
    assert asked == [["x"]] and sorted(map(tuple, filled.collect()), key=str) == [("a", 1.0, 3.0, "u"), ("a", 2.0, 3.0, "v"), ("b", 3.0, 4.0, None)] and log.count() == 1


def test_types_follow_from_the_schema(spark):
    sql = "SELECT cast(i % 2 as int) AS whole, cast(i % 2 as double) AS part, timestamp_seconds(i) AS at, cast(i as date) AS day, i % 2 = 0 AS truth FROM (SELECT explode(sequence(0, 9)) AS i)"
    df = spark.sql(sql.replace("cast(i as date)", "date_add(date'2024-01-01', i)"))
    assert types.detect_column_types(df) == {"numeric": ["whole", "part"], "datetime": ["at", "day"], "boolean": ["truth"]}
    assert types.detect_column_types(df, numeric_threshold=1.1, datetime_threshold=1.1) == {"boolean": ["whole", "truth"], "categorical": ["part", "at", "day"]}


def test_returns_are_found_once_for_all_parts(spark, monkeypatch):
    from datetime import datetime, timedelta

    from tabsignal.catalog import chains
    from tabsignal.operators import target
    from tabsignal.plans import stages

    r = random.Random(4)
    rows = [(i % 9, datetime(2024, 1, 1) + timedelta(hours=i), r.choice("abc"), float(r.randint(1, 40))) for i in range(900)]
    e = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double")
    calls, plain = [], target.compute_forward_return
    monkeypatch.setattr(target, "compute_forward_return", lambda *x, **y: calls.append(1) or plain(*x, **y))
    features, prices = e.select("user_id", "ts", F.col("value").alias("f"), (F.col("value") % 7).alias("g")), e.select("user_id", "ts", F.col("value").alias("adj_close"))
    cfg = chains._config(chains._RUN | {"wfa_split_method": "fractional"})
    parts, _log = stages.split_datasets(features, prices, cfg, "ts", window_frac=0.4, step_frac=0.2)
    assert len(parts) == 4 and calls == [1]
    # each part as prepared on its own
    low, high = datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(hours=899)
    for k, part in enumerate(parts[:3:2]):
        a, b = low + (high - low) * 0.4 * k, low + (high - low) * (0.4 * k + 0.4)
        alone = stages.prepared(features.filter((F.col("ts") >= a) & (F.col("ts") < b)), prices, cfg)
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, alone.select(*[f"`{c}`" for c in part.columns]).collect()))
    stages.release()
