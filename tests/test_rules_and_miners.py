"""Statistics, rules, miners, synthetic rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tabsignal.functions import metrics
from tabsignal.operators import miners, rules, stats, synth, validate

CONFIG = {"target_col": "t", "id_cols": [], "date_col": None, "drop_cols": [], "stat_min_support": 0.0}


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    rows = []
    for _ in range(400):
        a, b, c, d = (int(r.random() < p) for p in (0.5, 0.4, 0.3, 0.5))
        rows.append((a, b, c, d, "yes" if (a and b) or r.random() < 0.15 else "no"))
    return spark.createDataFrame(rows, "a int, b int, c int, d int, t string").cache(), rows


def expected(rows, rule, cls):
    names = "abcd"
    hit = [all(x[names.index(f)] == v for f, v in rule) for x in rows]
    a = sum(h and x[4] == cls for h, x in zip(hit, rows))
    na, nc, n, e = sum(hit), sum(x[4] == cls for x in rows), len(rows), 1e-12
    b, c, d = na - a, nc - a, n - na - nc + a
    conf, supp = a / (na + e), a / n
    lev = supp - na / n * nc / n
    return {
        "support": supp, "antecedent_support": na / n, "consequent_support": nc / n, "confidence": conf, "lift": conf / (nc / n + e), "leverage": lev,
        "conviction": (1 - nc / n + e) / (1 - conf + e), "zhangs_metric": lev / max(supp * (b + d) / n, nc / n * b / n, e), "jaccard": supp / (na / n + nc / n - supp + e),
        "representativity": a / (nc + e), "certainty": conf - c / (c + d + e), "kulczynski": 0.5 * (conf + supp / (nc / n + e)), "observations": a,
    }


def test_thirteen_metrics(table):
    df, rows = table
    got = stats.calculate_association_metrics(df, "t").collect()
    assert len(got) == 8 and len(metrics.get_stat_registry()) == 13
    for r in got:
        want = expected(rows, [(r["antecedents"][0], 1)], r["consequents"])
        assert {k: r[k] for k in want} == pytest.approx(want)
    assert [r["support"] for r in got] == sorted((r["support"] for r in got), reverse=True)


def test_counts_and_bad_features(spark, table):
    df, rows = table
    got = {(r["feature"], r["feature_value"], r["target"]): r["count"] for r in stats.binary_counts(df, ["a", "b"], "t").collect()}
    assert got["a", 1, "yes"] == sum(x[0] == 1 and x[4] == "yes" for x in rows) and sum(got.values()) == 800
    with pytest.raises(ValueError):
        stats.binary_counts(df.withColumn("a", F.lit(2)), ["a"], "t")
    constant = spark.createDataFrame([(1, "x"), (1, "y")], "f int, t string")
    assert stats.calculate_association_metrics(constant, "t").count() == 2
    assert stats.calculate_association_metrics(constant.limit(0), "t").count() == 0
    flags = spark.createDataFrame([(True, "x"), (None, "y")], "f boolean, t string")
    assert {r["observations"] for r in stats.calculate_association_metrics(flags, "t").collect()} == {1.0, 0.0}


def test_filters(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 2.0), ("d", float("nan")), ("e", None)], "antecedents string, lift double")
    pick = lambda **f: {r["antecedents"] for r in stats.apply_statistic_filters(df, f)[0].filter("selected").collect()}
    assert pick(stat_min_lift=1.0) == {"b", "c"} and pick(stat_max_lift=1.0) == {"a", "b"}
    assert pick(stat_bounds_lift=[0.9, 1.1]) == {"a", "c"} and pick(stat_range_lift=[0.9, 1.1]) == {"b"}
    assert pick(stat_min_lift=1.0, stat_max_lift=1.5) == {"b"}
    for bad in ({"stat_upper_lift": 1}, {"stat_min_nope": 1}):
        with pytest.raises(ValueError):
            stats.apply_statistic_filters(df, bad)
    with pytest.raises(ValueError):
        stats.extract_stat_filter_config({"x": 1})
    assert stats.build_filter_config({"stat_min_lift": 1, "x": 2}, {"stat_min_lift": 3}) == {"stat_min_lift": 3}


def test_registry():
    extended = metrics.extend_stat_registry({"double_lift": lambda m: m["a"] * 2}, ["jaccard"])
    assert "double_lift" in extended and "jaccard" not in extended
    for bad in ({"lift": lambda m: m["a"]}, {"x": lambda m: m["nope"]}):
        with pytest.raises(ValueError):
            metrics.extend_stat_registry(bad)
    with pytest.raises(TypeError):
        metrics.extend_stat_registry({"x": lambda m: 3})
    assert "lift" in metrics.extend_stat_registry({"lift": lambda m: m["a"]}, allow_override=True)
    with pytest.raises(ValueError):
        metrics.extend_stat_registry(exclude_stats=["nope"])


def test_rule_texts():
    tricky = [("brand", 1), ("x AND y", 0), ("it's (1, 2]", 1), ("back\\slash", 0)]
    assert rules.parse_rule_text(rules.rule_text(tricky)) == tricky
    assert rules.parse_rule_text("feat=a b == 1") == [("feat=a b", 1)]
    assert rules.compute_rule_depth(rules.rule_text(tricky)) == 4 and rules.compute_rule_depth(" ") == 0 and rules.compute_rule_depth("f == 1") == 1
    for bad in ("", "('a' = 1)", "('a' == 1) OR ('b' == 1)", "('a' == 2)"):
        with pytest.raises(ValueError):
            rules.parse_rule_text(bad)
    assert rules.parse_rule_string_to_tuples("brand > 0.5 and sand <= 0.5") == [("brand", 1), ("sand", 0)]
    assert rules.parse_rulefit_rules(["a > 0.5"]) == [[("a", 1)]]
    assert rules.parse_subgroup_rules(["(a==True AND target_x==True AND b==False)"]) == [[("a", 1), ("b", 0)]]
    assert rules.parse_apriori_rules([frozenset({"b", "a"})]) == [[("a", 1), ("b", 1)]]
    assert rules.normalize_rule([("b", 1), ("a", 0), ("b", 1)]) == [("a", 0), ("b", 1)]
    for bad, error in (([("a", 2)], ValueError), ([("a",)], ValueError), ([(1, 1)], TypeError), (["a"], ValueError), ([("a", True)], TypeError)):
        with pytest.raises(error):
            rules.validate_parsed_rules([bad])
    with pytest.raises(TypeError):
        rules.validate_parsed_rules([3])


def test_provenance_and_activation(spark, table):
    df, data = table
    unique, counts = rules.normalize_and_dedup_rules(rules.rules_table(spark, [([("b", 1), ("a", 1)], "x"), ([("a", 1), ("b", 1)], "y"), ([("c", 0)], "x")]))
    assert {tuple((c["feature"], c["value"]) for c in r["rule"]): r["sources"] for r in unique.collect()} == {(("a", 1), ("b", 1)): ["x", "y"], (("c", 0),): ["x"]}
    assert {r["source"]: r["n_rules"] for r in counts.collect()} == {"x": 2, "y": 1}
    out, texts = rules.generate_rule_activation_dataframe(df, [[("a", 1), ("c", 0)]], "t")
    assert out.columns == ["rule_0000", "t"] and texts == {"rule_0000": "('a' == 1) AND ('c' == 0)"}
    assert out.filter("rule_0000").count() == sum(x[0] == 1 and x[2] == 0 for x in data)
    with pytest.raises(KeyError):
        rules.generate_rule_activation_dataframe(df, [[("zz", 1)]], "t")
    got = rules.rule_stats(df, [[("a", 1), ("b", 0)]], "t").collect()
    for r in got:
        assert r["lift"] == pytest.approx(expected(data, [("a", 1), ("b", 0)], r["consequents"])["lift"]) and r["rule_depth"] == 2


def test_many_rules_are_counted_in_chunks(table, monkeypatch):
    df, data = table
    monkeypatch.setattr(stats, "CHUNK", 3)
    every = [[(f, v), (g, w)] for f, g in itertools.combinations("abcd", 2) for v in (0, 1) for w in (0, 1)]
    for r in rules.rule_stats(df, every, "t").collect():
        assert r["observations"] == expected(data, rules.parse_rule_text(r["antecedents"]), r["consequents"])["observations"]


def test_apriori_is_exhaustive(table):
    df, data = table
    got = {(tuple(r["antecedents"]), r["consequents"]): r["lift"] for r in miners.perform_apriori(df, "t", 0.02, "lift", 0.0).collect()}
    want = {}
    for k in (2, 3, 4):
        for c in itertools.combinations("abcd", k):
            for cls in ("yes", "no"):
                e = expected(data, [(f, 1) for f in c], cls)
                if e["support"] >= 0.02:
                    want[c, cls] = e["lift"]
    assert got == pytest.approx(want)
    assert all(len(a) == 2 for a, _ in ((tuple(r["antecedents"]), 0) for r in miners.perform_apriori(df, "t", 0.02, max_len=2).collect()))


def test_subgroups_find_the_planted_rule(table):
    df, _ = table
    best = miners.perform_subgroup_discovery(df, "t", 5, 2, 10)
    rule, cls, quality = next(x for x in best if x[1] == "yes")
    assert rule == [("a", 1), ("b", 1)] and quality > 0


def test_tree_rules_keep_their_polarity(table):
    df, data = table
    paths = miners.perform_cart(df, "t", 3)
    assert paths and sum(sum(all(x["abcd".index(f)] == v for f, v in p) for x in data) for p in paths) == len(data)  # leaves part the rows
    hot = max(paths, key=lambda p: expected(data, p, "yes")["confidence"] if expected(data, p, "yes")["observations"] > 10 else 0)
    assert {("a", 1), ("b", 1)} <= set(hot)
    ensemble = miners.mine_rulefit(df, "t")
    assert ensemble and all(len(r) >= 2 for r in ensemble)
    with pytest.raises(ValueError):
        miners.perform_rulefit(df.withColumn("a", F.lit(None).cast("int")), "t")


def test_covering_and_classifier_system(table):
    df, _ = table
    first, cls = miners.perform_cn2(df, "t", max_rules=3)[0]
    assert len(first) <= 3 and cls in ("yes", "no")
    evolved = miners.perform_elcs(df, "t")
    assert evolved == miners.perform_elcs(df, "t") and any(set(r) >= {("a", 1), ("b", 1)} for r, c in evolved if c == "yes")
    with pytest.raises(ValueError):
        miners.mine_cn2(df.withColumn("a", F.lit(3)), "t")


def test_mine_stats(table):
    df, _ = table
    out, counts = miners.mine_stats(df, "t", ["univar", "apriori", "subgroup"], CONFIG, subgroup_depth=2)
    assert {r["source"] for r in counts.collect()} == {"univar", "apriori", "subgroup"}
    assert out.filter("rule_depth = 1").count() == 8 and out.filter("rule_depth > 1").count() > 0 and "selected" in out.columns
    with pytest.raises(ValueError):
        miners.mine_stats(df, "t", ["magic"], CONFIG)
    with pytest.raises(ValueError):
        miners.mine_univar(df, CONFIG | {"target_col": "zz"})


def test_preparation(spark):
    df = spark.createDataFrame([(i, "2020", "drop", i % 2, "ab"[i % 2]) for i in range(300)], "id int, date string, x string, f int, t string")
    out, log = miners.prepare_dataframe_for_mining(df, "date", ["id"], ["x"], "t", sample_size=100)
    assert out.columns == ["f", "t"] and 50 < out.count() < 160 and log.first()["rows_before"] == 300
    assert miners.prepare_dataframe_for_mining(df, "date", ["id"], ["x"], "t", drop_duplicates=True)[0].count() == 2


def test_flips_and_imbalance(table):
    df, data = table
    flags = df.withColumn("a", F.col("a") == 1)
    flipped = synth.flip_boolean_values(flags, ["a"], 0.3)
    again = synth.flip_boolean_values(flags, ["a"], 0.3)
    assert sorted(flipped.collect()) == sorted(again.collect())
    numbered = flags.withColumn("id", F.monotonically_increasing_id())
    before = dict(map(tuple, numbered.select("id", "a").collect()))
    changed = sum(r["a"] != before[r["id"]] for r in synth.flip_boolean_values(numbered, ["a"], 0.3).collect())
    assert 60 < changed < 180
    assert sorted(synth.flip_boolean_values(flags, ["a"], 0.0).collect()) == sorted(flags.collect())
    labels = [r["t"] for r in synth.flip_labels(df, "t", 1.0).collect()]
    assert set(labels) == {"yes", "no"} and len(labels) == len(data)
    shares = {r["target"]: r["proportion"] for r in synth.generate_skewed_proportions(df, "t").collect()}
    n = {c: sum(x[4] == c for x in data) for c in ("yes", "no")}
    raw = {c: (400 / k) ** 1.5 for c, k in n.items()}
    assert shares == pytest.approx({c: w / sum(raw.values()) for c, w in raw.items()})
    drawn = [r["t"] for r in synth.apply_class_imbalance(df, "t", {"yes": 0.9, "no": 0.1}).collect()]
    assert 300 < len(drawn) < 500 and drawn.count("yes") > 5 * drawn.count("no")
    with pytest.raises(ValueError):
        synth.flip_labels(df, "t", 2)


def test_copula(spark):
    r = random.Random(1)
    rows = [(x := r.gauss(0, 1), 3 * x + r.gauss(0, 0.5), r.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    made, quality = synth.generate_synthetic_data(df, 800)
    assert made.count() == 800 and made.agg(F.corr("x", "y")).first()[0] > 0.9 and abs(made.agg(F.corr("x", "z")).first()[0]) < 0.2
    assert all(q["quality"] > 0.8 for q in quality.collect())
    with pytest.raises(NotImplementedError):
        synth.generate_synthetic_data(df, 5, "ctgan")
    with pytest.raises(ValueError):
        synth.generate_synthetic_data(df.withColumn("x", F.lit(None).cast("double")), 5)
    assert synth.coalesce_data(df, made).count() == 1300 and synth.coalesce_data(df, None, made).count() == 800
    with pytest.raises(ValueError):
        synth.generate_combined_synthetic_data(df, to_sdv=False, to_synthcity=False)


def test_poisson(spark):
    got = [r[0] for r in spark.range(20_000).select(synth.poisson(synth.uniform(F.col("id"), 1), F.lit(1.0)).alias("k")).collect()]
    fixed = [r[0] for r in spark.range(20_000).select(synth.fixed_poisson(synth.uniform(F.col("id"), 1), 1.0).alias("k")).collect()]
    assert fixed == got
    assert sum(got) / 20_000 == pytest.approx(1, abs=0.03) and got.count(0) / 20_000 == pytest.approx(math.exp(-1), abs=0.02)


def test_rare_class_is_repeated_without_bound(spark):
    df = spark.range(40_000).selectExpr("id", "if(id < 20, 'rare', 'common') AS t")
    got = {r["t"]: r["count"] for r in synth.apply_class_imbalance(df, "t", {"rare": 0.999, "common": 0.001}).groupBy("t").count().collect()}
    assert got["rare"] == 20 * 1998  # a rate of 1998, over which exp(-rate) is 0
    df = spark.range(10_000).selectExpr("id", "if(id % 100 = 0, 'rare', 'common') AS t")
    got = {r["t"]: r["count"] for r in synth.apply_class_imbalance(df, "t").groupBy("t").count().collect()}
    want = 10_000 * 99**1.5 / (99**1.5 + 1)
    assert abs(got["rare"] - want) < 60
    one = spark.range(30_000).selectExpr("id", "if(id = 0, 'rare', 'common') AS t")
    assert synth.apply_class_imbalance(one, "t", {"rare": 1.0}).groupBy("id").count().collect()[0]["count"] == 30_000


@pytest.mark.parametrize("make", ["flips", "labels", "imbalance", "sample", "bootstrap", "null", "shuffle"])
def test_draws_do_not_depend_on_partitions(spark, make):
    rows = [(i % 2, int(i % 5 == 0), "ab"[i % 3 == 0]) for i in range(600)]
    runs = []
    for n in (1, 200):
        df = spark.createDataFrame(rows, "a int, b int, t string").repartition(n)
        rules_ = [[("a", 1)], [("a", 1), ("b", 0)]]
        out = {
            "flips": lambda: synth.flip_boolean_values(df, ["a"], 0.3),
            "labels": lambda: synth.flip_labels(df, "t", 0.3),
            "imbalance": lambda: synth.apply_class_imbalance(df, "t"),
            "sample": lambda: miners.prepare_dataframe_for_mining(df, "", [], [], "t", sample_size=100)[0],
            "bootstrap": lambda: validate.bootstrap_stats(df, rules_, "t", 5),
            "null": lambda: validate.null_stats(df, rules_, "t", range(5)),
            "shuffle": lambda: validate.shuffle_dataframe(df, "target", "t", 3),
        }[make]()
        runs.append(sorted(map(tuple, out.collect())))
        rows = rows[::-1]
    assert runs[0] == runs[1] and runs[0]


def test_sample_is_stratified(spark):
    df = spark.range(10_000).selectExpr("cast(id % 2 as int) f", "if(id % 1000 = 0, 'rare', if(id % 4 = 0, 'some', 'most')) t")
    out, log = miners.prepare_dataframe_for_mining(df, "", [], [], "t", sample_size=1000)
    assert {r["t"]: r["count"] for r in out.groupBy("t").count().collect()} == {"rare": 1, "some": 249, "most": 750} and log.first()["rows_after"] == 1000


def test_too_many_classes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(miners, "CLASSES", 3)
    df = spark.range(20).selectExpr("cast(id % 2 as int) f", "cast(id % 4 as string) t")
    with pytest.raises(ValueError):
        miners.perform_cart(df, "t")


def test_copula_of_texts_and_booleans(spark):
    r = random.Random(4)
    rows = [(x := r.gauss(0, 1), "low" if x < -0.5 else "high" if x > 0.8 else "mid", x + r.gauss(0, 0.3) > 0) for _ in range(1500)]
    df = spark.createDataFrame(rows, "x double, band string, up boolean")
    made = synth.generate_synthetic_data_copula(df, 3000)
    assert made.dtypes == df.dtypes
    share = lambda d: {v["band"]: v["count"] / d.count() for v in d.groupBy("band").count().collect()}
    assert share(made) == pytest.approx(share(df), abs=0.04)
    assert abs(made.filter("up").count() / 3000 - df.filter("up").count() / 1500) < 0.04
    assert made.filter("up").agg(F.avg("x")).first()[0] > made.filter("not up").agg(F.avg("x")).first()[0] + 0.8
    got = [x[0] for x in spark.createDataFrame([(v / 10,) for v in range(-40, 41)], "v double").select(synth.normal_share(F.col("v"))).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(v / 10 / math.sqrt(2))) for v in range(-40, 41)], abs=1e-6)
    with pytest.raises(ValueError):
        synth.generate_synthetic_data_copula(df.withColumn("d", F.current_date()), 5)
