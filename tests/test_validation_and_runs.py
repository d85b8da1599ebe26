"""Splits, out-of-sample tests, resampling, corrections, configuration, runs."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsignal import config
from tabsignal.operators import grouping, rules, splits, validate
from tabsignal.plans import research, stages
from tabsignal.sources import tables
from tabsignal.sources.steplog import PipelineLogger
from tabsignal.streaming import each_batch


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(datetime(2020, 1, 1) + timedelta(days=i), i) for i in range(10)], "date timestamp, v int")


def sizes(parts):
    return [p.count() for p in parts]


def test_time_splits(days):
    parts, log = splits.generate_time_splits(days, "date", 3)
    assert sizes(parts) == [3, 3, 4] and [r["n_rows"] for r in log.orderBy("split").collect()] == [3, 3, 4]
    ranges = [["2020-01-05", "2020-01-08"], ["2020-01-01", "2020-01-05"]]
    assert sizes(splits.generate_time_splits(days, "date", date_ranges=ranges)[0]) == [4, 3]
    assert sizes(splits.generate_time_splits(days.limit(1), "date", 1)[0]) == [1]
    for bad in (None, "x", [["2020-01-01"]], [["2021-01-01", "2020-01-01"]]):
        with pytest.raises(ValueError):
            splits.parse_date_ranges(bad)
    with pytest.raises(ValueError):
        splits.generate_time_splits(days.limit(0), "date", 2)


def test_fraction_splits(days):
    assert sizes(splits.generate_fraction_splits(days, "date", fractions=[0.6, 0.4])[0]) == [6, 4]
    assert sizes(splits.generate_fraction_splits(days, "date", n_splits=2)[0]) == [5, 5]
    assert len(splits.generate_fraction_splits(days, "date", n_splits=2, overlap=True)[0]) == 3
    assert [x for w in splits.fraction_windows(window_frac=0.4, step_frac=0.3) for x in w] == pytest.approx([0, 0.4, 0.3, 0.7, 0.6, 1.0])
    for bad in (dict(fractions=[0.9, 0.9]), dict(), dict(window_frac=2.0)):
        with pytest.raises(ValueError):
            splits.fraction_windows(**bad)


def test_row_numbers_over_ranges(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 40), i) for i in range(500)] + [(None, 999)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = {x["i"]: x["n"] for x in grouping.global_row_number(df, ["k", "i"], "n").collect()}
    want = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == {x[1]: n for n, x in enumerate(want)}


@pytest.mark.parametrize("mode", ["traditional", "block", "block_ids"])
def test_resampling_keeps_the_row_count(spark, days, mode):
    df = days.withColumn("g", (F.col("v") >= 5).cast("string"))
    out = validate.resample_dataframe(df, mode, 3, "date", ["g"])
    got = [r["v"] for r in out.collect()]
    assert len(got) == 10 and set(got) <= set(range(10)) and out.columns == df.columns
    assert sorted(got) == sorted(r["v"] for r in validate.resample_dataframe(df, mode, 3, "date", ["g"]).collect())
    if mode == "block_ids":
        assert sum(v < 5 for v in got) == 5
    with pytest.raises(ValueError):
        validate.resample_dataframe(df, "magic")


def test_shuffles_keep_what_they_should(spark):
    df = spark.createDataFrame([(i, i % 3, "ab"[i % 2]) for i in range(200)], "i int, f int, t string")
    key = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    t = validate.shuffle_dataframe(df, "target", "t", 5)
    assert key(t, "i", "f") == key(df, "i", "f") and key(t, "t") == key(df, "t") and key(t, "i", "t") != key(df, "i", "t")
    c = validate.shuffle_dataframe(df, "columns", random_state=5)
    assert all(key(c, x) == key(df, x) for x in ("i", "f", "t")) and key(c, "i", "f") != key(df, "i", "f")
    r = validate.shuffle_dataframe(df, "rows", random_state=5)
    assert key(r, "i", "f", "t") == key(df, "i", "f", "t")
    for bad in (dict(mode="magic"), dict(mode="target", target_col="zz")):
        with pytest.raises(ValueError):
            validate.shuffle_dataframe(df, **bad)


def benjamini(ps, by=False):
    m, order = len(ps), sorted(range(len(ps)), key=lambda i: ps[i])
    factor = sum(1 / i for i in range(1, m + 1)) if by else 1.0
    out, low = [0.0] * m, 1.0
    for rank in range(m, 0, -1):
        low = min(low, ps[order[rank - 1]] * m * factor / rank)
        out[order[rank - 1]] = low
    return out


@pytest.mark.parametrize("method", ["fdr_bh", "fdr_by"])
def test_corrections(spark, method):
    r = random.Random(3)
    ps = [round(r.random() ** 3, 2) for _ in range(60)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(99, None)], "i int, p double")
    got = {x["i"]: x["a"] for x in validate.adjust_pvals(df, "p", method, "a").collect()}
    assert got.pop(99) is None and [got[i] for i in range(60)] == pytest.approx(benjamini(ps, method == "fdr_by"))
    with pytest.raises(ValueError):
        validate.adjust_pvals(df, "p", "magic")


@pytest.mark.parametrize("mode", ["greater", "less", "two-sided"])
def test_empirical_pvals(spark, mode):
    r = random.Random(4)
    null, actual = [round(r.gauss(1, 0.3), 1) for _ in range(300)], [0.2, 1.0, 1.3, 5.0, -3.0, 1.0]
    mid = sorted(null)[149] / 2 + sorted(null)[150] / 2
    test = {"greater": lambda a, z: z >= a, "less": lambda a, z: z <= a, "two-sided": lambda a, z: abs(z - mid) >= abs(a - mid)}[mode]
    got = validate.compute_empirical_pvals(spark.createDataFrame([(i, x) for i, x in enumerate(actual)] + [(9, None)], "i int, lift double"), spark.createDataFrame([(x,) for x in null], "lift double"), "lift", mode)
    found = {x["i"]: x["pval"] for x in got.collect()}
    assert found.pop(9) is None and [found[i] for i in range(6)] == pytest.approx([sum(test(a, z) for z in null) / 300 for a in actual])


def test_fdr(spark):
    actual = spark.createDataFrame([("r", "c", 9.0), ("s", "c", 1.0)], "antecedents string, consequents string, lift double")
    null = spark.createDataFrame([(i, 1 + (i % 10) / 10) for i in range(100)], "permutation int, lift double")
    out = validate.validate_multiple_tests(actual, null)
    assert {r["antecedents"]: r["fdr_bh_significant"] for r in out.collect()} == {"r": True, "s": False}
    summary = validate.summarize_fdr_results(out, fdr_sig_col="fdr_bh_significant")
    assert summary.first()["n_fdr_significant"] == 1
    assert validate.summarize_fdr_results(out, fdr_sig_col="fdr_bh_significant", groupby_col="consequents", as_markdown=True).startswith("| consequents")
    with pytest.raises(ValueError):
        validate.validate_multiple_tests(actual, null, "nope")
    assert validate.compute_relative_error(null, "lift", "permutation", 200) is None
    assert validate.compute_relative_error(null, "lift", "permutation", 10) == pytest.approx(pd.Series([1 + i / 10 for i in range(10)]).std() / 1.45)
    assert validate.summarize_null_distribution(null, "lift", "permutation").first()["n_permutations"] == 100


@pytest.fixture(scope="module")
def mined(spark):
    r = random.Random(6)
    rows = [(a := int(r.random() < 0.5), b := int(r.random() < 0.5), "yes" if a and b or r.random() < 0.1 else "no") for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, t string").cache()
    stats = rules.rule_stats(df, [[("a", 1), ("b", 1)], [("a", 1)]], "t").withColumn("selected", F.lit(True))
    return df, stats


def test_out_of_sample(mined):
    df, stats = mined
    single = stats.filter("rule_depth = 1")
    cfg = {"stat_min_support": 0.0}
    again = validate.test_mined_rules(stats, df, cfg, "t")
    assert again.count() == 4 and validate.test_mined_rules(single, df, cfg, "t").count() == 2
    assert validate.test_mined_rules(stats.withColumn("selected", F.lit(False)), df, cfg, "t").count() == 0
    combined = validate.combine_split_results([stats, stats.filter("rule_depth = 2")])
    assert combined.count() == 4 and "split_1_lift" in combined.columns
    log = validate.create_validation_log_df(combined).orderBy("split").collect()
    assert [r["n_selected"] for r in log] == [4, 2] and log[0]["overlap"] == 2
    active, texts = validate.make_combined_rule_feature_df(stats, df, "t")
    assert len(texts) == 2 and active.count() == 500
    assert validate.rules_series_to_unique_rules(["('a' == 1)", "a == 1"], provenance=True) == [([("a", 1)], ["('a' == 1)", "a == 1"])]


def test_bootstrap_and_null(mined):
    df, stats = mined
    lifts = {(r["antecedents"], r["consequents"]): r["lift"] for r in stats.collect()}
    summary, log = validate.validate_bootstrap(df, stats, {"stat_min_support": 0.0}, "t", 20)
    for r in summary.collect():
        assert r["selected_count"] == 20 and r["lift_q05"] <= r["lift_mean"] <= r["lift_q95"]
        assert r["lift_mean"] == pytest.approx(lifts[r["antecedents"], r["consequents"]], rel=0.1)
    assert log.first()["n_rules"] == 4
    null, about = validate.validate_null(df, stats, "t", n_null=6, es_m_permutations=3, rel_error_threshold=0.0)
    assert about.first()["n_permutations"] == 6 and about.first()["mean"] == pytest.approx(1, abs=0.1)
    totals = null.select("consequent_support").distinct().count()
    assert totals == 2  # shuffling keeps the classes' shares
    stopped, about = validate.validate_null(df, stats, "t", n_null=50, es_m_permutations=3, rel_error_threshold=99.0)
    assert about.first()["n_permutations"] == 3


def test_config(tmp_path):
    assert len(config.gather_known_keys()) == 144
    (tmp_path / "a.yaml").write_text("run_name: mine\nn_null: 7\n")
    merged = config.load_params(tmp_path / "a.yaml", {"n_null": 9})
    assert merged["n_null"] == 9 and merged["run_name"] == "mine" and merged["block_size"] == 4
    assert config.load_params(str(tmp_path / "missing.yaml"), None)["n_null"] == 1000
    assert "n_null: 9" in config.pretty_print_params(merged, True)
    for bad in ({"zzz": 1}, {"n_null": "x"}, {"n_null": True}, {"scaling_method": "magic"}, {"bin_quantiles": [0, 0.5]}, {"bin_quantiles": [0, 1], "bin_quantile_labels": ["a", "b"]}, {"winsor_cols": 3}, {"target_bins": [3, 1]}, {"target_binning_method": "binary"}, {"id_cols": [1]}):
        with pytest.raises(ValueError):
            config.load_params(None, bad)
    with pytest.raises(TypeError):
        config.load_params(3)
    with pytest.raises(ValueError):
        config.load_params("x.txt")
    with pytest.raises(ValueError):
        stages.with_overrides(config.make_config(), {"nope": 1})


def test_tables_and_logs(spark, tmp_path, days):
    for kind in ("csv", "parquet"):
        path = tables.save_table(days, str(tmp_path / "out.xyz"), kind, single=True)
        assert path.endswith(kind) and tables.load_table(spark, path).count() == 10
    for bad, error in ((str(tmp_path / "no.csv"), FileNotFoundError), (str(tmp_path / "x.json"), ValueError)):
        with pytest.raises(error):
            tables.load_table(spark, bad)
    with pytest.raises(ValueError):
        tables.save_table(days, str(tmp_path / "o"), "json")
    tables.save_params_to_yaml({"b": 1, "a": [2]}, str(tmp_path / "p.yaml"))
    assert Path(tables.copy_yaml_to_output(str(tmp_path / "p.yaml"), str(tmp_path / "sub"))).read_text().startswith("b: 1")
    with pytest.raises(FileNotFoundError):
        tables.copy_yaml_to_output(str(tmp_path / "q.yaml"), str(tmp_path))
    log = PipelineLogger(str(tmp_path), max_rows=2)
    log.log_step("one", {"k": 1}, {"days": days})
    log.log_step("two", df=[days, days], max_rows=1)
    lines = [json.loads(x) for x in (tmp_path / "log.jsonl").read_text().splitlines()]
    assert [len(v) for v in lines[0]["data_samples"].values()] == [2] and len(lines[1]["data_samples"]) == 2
    assert "## one" in (tmp_path / "log.md").read_text()


def test_files_by_scheme(spark, tmp_path, days):
    """Paths with a scheme go through Spark's file systems."""
    folder = f"file://{tmp_path}/a.b"
    log = PipelineLogger(folder, "steps")
    log.log_step("one", {"k": 1}, days)
    log.log_step("two")
    assert [json.loads(x)["step"] for x in (tmp_path / "a.b/steps.jsonl").read_text().splitlines()] == ["one", "two"]
    tables.save_params_to_yaml({"b": 1}, tables.under(folder, "p.yaml"))
    assert tables.file_exists(f"{folder}/p.yaml") and not tables.file_exists(f"{folder}/q.yaml")
    path = tables.save_table(days, f"{folder}/days", "parquet")
    assert path == f"{folder}/days.parquet" and tables.load_table(spark, path).count() == 10


def test_repeated_names_are_an_error():
    with pytest.raises(ValueError):
        config.load_params(None, {"winsor_cols": ["a", "a"]})


def test_stream(spark, tmp_path, days):
    days.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in"))
    each_batch(stream, lambda b: b.filter("v > 3"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_whole_run_and_grid(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    start = datetime(2020, 1, 1)
    feats = [(t, start + timedelta(days=d), r.gauss(0, 1), r.gauss(5, 2)) for t in "AB" for d in range(0, 240, 2)]
    prices = [(t, start + timedelta(days=d), 100 + 10 * r.random()) for t in "AB" for d in range(300)]
    spark.createDataFrame(feats, "ticker string, date timestamp, f1 double, f2 double").write.parquet(str(tmp_path / "f.parquet"))
    spark.createDataFrame(prices, "ticker string, date timestamp, adj_close double").write.parquet(str(tmp_path / "p.parquet"))
    small = {"miners": ["univar"], "to_engineer_lags": False, "n_bootstrap": 3, "n_null": 2, "es_m_permutations": 2, "target_periods": 5, "log_max_rows": 2, "stat_min_support": 0.0, "stat_min_observations": 0, "stat_bounds_lift": [1.0, 1.0], "bin_quantile_labels": ["q1", "q2", "q3", "q4"], "target_bins": [-1.0, 0.0, 1.0], "target_labels": ["down", "up"]}
    out = research.research_pipeline(spark, True, False, True, True, None, small, str(tmp_path / "f.parquet"), str(tmp_path / "p.parquet"), str(tmp_path / "res"))
    assert {"train_test_results", "train_test_log", "mining_results", "bootstrap_results", "null_df", "fdr_res"} <= set(out)
    assert out["mining_results"].count() > 0 and (tmp_path / "res/my_first_test/merged_config.yaml").exists()
    with pytest.raises(ValueError):
        research.research_pipeline(spark, False, False, False, False)
    grid = {"param_space": {"target_periods": [5, 6]}, "feature_path": "f.parquet", "hloc_path": "p.parquet", "res_save_path": "grid", "to_train_test": False, "to_wfa": False, "to_null_fdr": False, "to_bootstrap": True, "custom_params": small | {"n_bootstrap": 1}}
    import yaml

    stages.release()
    seen = []

    def run(spark, *toggles, custom_params, res_save_path, **rest):
        seen.append((toggles, custom_params["target_periods"]))
        folder = Path(res_save_path) / custom_params["run_name"]
        folder.mkdir(parents=True)
        (folder / research.DONE).write_text("")

    monkeypatch.setattr(research, "RUN", run)
    (tmp_path / "g.yaml").write_text(yaml.safe_dump(grid))
    assert research.generate_param_grid({"b": [1, 2], "a": 3}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert research.grid_research_pipeline(spark, str(tmp_path / "g.yaml")) == ["run_1", "run_2"]
    assert seen == [((False, False, True, False), 5), ((False, False, True, False), 6)]
    assert research.grid_research_pipeline(spark, str(tmp_path / "g.yaml")) == []  # finished runs are skipped
    with pytest.raises(FileNotFoundError):
        research.grid_research_pipeline(spark, "nope.yaml")


def test_dataset_checks(spark):
    good = spark.createDataFrame([("A", datetime(2020, 1, 1), 1.0)], "ticker string, date timestamp, f double")
    bad = spark.createDataFrame([("A", "soon", "x")], "ticker string, date string, adj_close string")
    cfg = config.make_config()
    assert research.validate_datasets(good, None, cfg) == []
    assert len(research.validate_datasets(good.drop("f"), bad, cfg, strict=False)) == 3
    with pytest.raises(ValueError):
        research.validate_datasets(good, bad, cfg)


def test_queries_have_sql():
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(sql) > 90 and callable(names["rule_metrics"])
