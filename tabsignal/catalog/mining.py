"""Queries on statistics, rules, miners, synthetic rows, splits and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import composite_score
from ..operators import features, miners, rules, splits, stats, synth, validate
from .base import EVENTS, FEATURES, RULES, events, metrics_sql, query, rounded, rules_input, table

FILTERS = {"stat_min_support": 0.05, "stat_bounds_lift": [0.99, 1.01], "stat_min_observations": 20}
CONFIG = FILTERS | {"target_col": "status", "id_cols": [], "date_col": None, "drop_cols": []}
RULE_LIST = [[("big", 1), ("discounted", 1)], [("big", 1), ("returned", 0)], [("dear", 1)], [("discounted", 0), ("dear", 1), ("big", 1)]]

_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{f} == 1' AS antecedents, {f} AS v, status FROM input" for f in FEATURES) + ")"
_COUNTS = """c AS (SELECT antecedents, status AS consequents, sum(v) AS a, sum(sum(v)) OVER (PARTITION BY antecedents) AS na, count(*) AS nc, sum(count(*)) OVER (PARTITION BY antecedents) AS n FROM l GROUP BY antecedents, status)"""
_METRICS = f"WITH {RULES}, {_LONG}, {_COUNTS} {metrics_sql('c')}"


def _text(rule):
    return rules.rule_text(sorted(rule))


_RULE_LONG = "l AS (" + " UNION ALL ".join("SELECT '" + _text(r).replace("'", "''") + "' AS antecedents, CAST(" + " AND ".join(f"{f} = {v}" for f, v in r) + f" AS INT) AS v, status, {len(r)} AS rule_depth FROM input" for r in RULE_LIST) + ")"
_RULE_COUNTS = _COUNTS.replace("SELECT antecedents,", "SELECT antecedents, max(rule_depth) AS rule_depth,")
_RULE_METRICS = f"WITH {RULES}, {_RULE_LONG}, {_RULE_COUNTS} {metrics_sql('c', 'antecedents, consequents, rule_depth')}"
_SELECTED = "support >= 0.05 AND (lift <= 0.99 OR lift >= 1.01) AND observations >= 20"


def _rules(spark, sf_dir):
    df = rules_input(spark, sf_dir)
    return df, rules.rule_stats(df, [sorted(r) for r in RULE_LIST], "status")


@query("binary_counts", f"""WITH {RULES}, l AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS feature_value, status FROM input" for f in FEATURES)})
SELECT feature, feature_value, status AS target, count(*) AS "count" FROM l GROUP BY ALL""")
def _(spark, sf_dir):
    return stats.binary_counts(rules_input(spark, sf_dir), FEATURES, "status")


@query("rule_metrics", _METRICS)
def _(spark, sf_dir):
    return rounded(stats.calculate_association_metrics(rules_input(spark, sf_dir), "status"))


@query("rule_filters", f"SELECT *, {_SELECTED} AS selected FROM ({_METRICS})")
def _(spark, sf_dir):
    return rounded(stats.generate_statistics(rules_input(spark, sf_dir), CONFIG)[0])


@query("rule_filter_summary", f"SELECT count(*) AS n_rules, count(*) FILTER ({_SELECTED}) AS n_selected, round(min(lift), 5) AS lift_min, round(max(lift), 5) AS lift_max, round(avg(lift), 5) AS lift_mean FROM ({_METRICS})")
def _(spark, sf_dir):
    return rounded(stats.generate_statistics(rules_input(spark, sf_dir), CONFIG)[1].select("n_rules", "n_selected", "lift_min", "lift_max", "lift_mean"), 5)


@query("composite_score", f"SELECT antecedents, consequents, round(lift * confidence * sqrt(support), 4) AS score FROM ({_METRICS})")
def _(spark, sf_dir):
    m = stats.calculate_association_metrics(rules_input(spark, sf_dir), "status")
    return rounded(m.select("antecedents", "consequents", composite_score({c: F.col(c) for c in m.columns}).alias("score")), 4)


@query("prep_dedup", f"WITH {RULES} SELECT DISTINCT big, discounted, returned, dear, status FROM input")
def _(spark, sf_dir):
    return miners.prepare_dataframe_for_mining(rules_input(spark, sf_dir), "", [], [], "status", drop_duplicates=True)[0]


_ITEMSETS = " UNION ALL ".join(
    "SELECT '" + ",".join(c) + "' AS antecedents, status AS consequents, count(*) FILTER (" + " AND ".join(f"{f} = 1" for f in c) + ") AS ac, sum(count(*) FILTER (" + " AND ".join(f"{f} = 1" for f in c) + ")) OVER () AS na, count(*) AS nc, sum(count(*)) OVER () AS n FROM input GROUP BY status"
    for k in (2, 3, 4)
    for c in __import__("itertools").combinations(sorted(FEATURES), k)
)


@query("apriori_rules", f"""WITH {RULES}, c AS ({_ITEMSETS})
SELECT antecedents, consequents, round(ac / n, 6) AS support, round(ac / na, 6) AS confidence, round(ac / na / (nc / n), 6) AS lift, round(ac / n - (na / n) * (nc / n), 6) + 0.0 AS leverage
FROM c WHERE ac >= 0.01 * n AND ac / na / (nc / n) >= 1.0""")
def _(spark, sf_dir):
    found = miners.perform_apriori(rules_input(spark, sf_dir), "status", 0.01, "lift", 1.0)
    return rounded(found.select(F.concat_ws(",", "antecedents").alias("antecedents"), "consequents", "support", "confidence", "lift", "leverage"))


_PAIRS = [(a, b) for i, a in enumerate(sorted(FEATURES)) for b in sorted(FEATURES)[i + 1 :]]


@query("subgroup_wracc_d2", f"""WITH {RULES}, t AS (SELECT count(*) AS n FROM input), c AS ({" UNION ALL ".join(f"SELECT '{a},{b}' AS rule, status, count(*) FILTER ({a} = 1 AND {b} = 1) AS k, sum(count(*) FILTER ({a} = 1 AND {b} = 1)) OVER () AS ns, count(*) AS p FROM input GROUP BY status" for a, b in _PAIRS)})
SELECT rule, status AS target, round(ns / n * (k / ns - p / n), 6) + 0.0 AS quality FROM c, t WHERE ns > 0""")
def _(spark, sf_dir):
    found = miners.perform_subgroup_discovery(rules_input(spark, sf_dir), "status", 50, 2, 50)
    return rounded(spark.createDataFrame([(",".join(f for f, _ in r), c, float(q)) for r, c, q in found], "rule string, target string, quality double"))


_SOURCES = [([("b", 1), ("a", 0)], "x"), ([("a", 0), ("b", 1)], "y"), ([("c", 1)], "x"), ([("c", 1)], "x"), ([("d", 0), ("a", 1)], "z")]
_SOURCE_VALUES = "v AS (SELECT * FROM (VALUES ('a:0,b:1', 'x'), ('a:0,b:1', 'y'), ('c:1', 'x'), ('c:1', 'x'), ('a:1,d:0', 'z')) AS t(rule, source))"


@query("rule_normalize_dedup", f"WITH {_SOURCE_VALUES} SELECT rule, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM v GROUP BY rule")
def _(spark, sf_dir):
    unique, _counts = rules.normalize_and_dedup_rules(rules.rules_table(spark, _SOURCES))
    text = F.concat_ws(",", F.transform("rule", lambda c: F.concat(c["feature"], F.lit(":"), c["value"].cast("string"))))
    return unique.select(text.alias("rule"), F.concat_ws(",", "sources").alias("sources"))


@query("rule_provenance", f"WITH {_SOURCE_VALUES} SELECT source, count(DISTINCT rule) AS n_rules FROM v GROUP BY source")
def _(spark, sf_dir):
    return rules.normalize_and_dedup_rules(rules.rules_table(spark, _SOURCES))[1]


@query("rule_activation", "WITH " + RULES + " SELECT status, " + ", ".join("CAST(sum(CAST(" + " AND ".join(f"{f} = {v}" for f, v in r) + f" AS INT)) AS BIGINT) AS rule_{i:04d}" for i, r in enumerate(RULE_LIST)) + " FROM input GROUP BY status")
def _(spark, sf_dir):
    out, texts = rules.generate_rule_activation_dataframe(rules_input(spark, sf_dir), RULE_LIST, "status")
    return out.groupBy("status").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in texts])


@query("multivar_stats", _RULE_METRICS)
def _(spark, sf_dir):
    return rounded(_rules(spark, sf_dir)[1])


@query("merge_rule_texts", f"SELECT m.antecedents, m.consequents, CASE m.antecedents WHEN 'big == 1' THEN 'large orders' END AS human_readable_rule FROM ({_METRICS}) m")
def _(spark, sf_dir):
    m = stats.calculate_association_metrics(rules_input(spark, sf_dir), "status")
    return rules.merge_multivar_map_into_stats(m, {"big": "large orders"}).select("antecedents", "consequents", "human_readable_rule")


@query("mine_univar_apriori", f"""WITH {RULES}, c AS ({_ITEMSETS}), u AS (SELECT antecedents, consequents, lift, observations FROM ({_METRICS}))
SELECT antecedents, consequents, observations, 1 AS rule_depth FROM u
UNION ALL SELECT array_to_string(list_transform(string_split(antecedents, ','), lambda f: '(''' || f || ''' == 1)'), ' AND '), consequents, CAST(ac AS DOUBLE), len(string_split(antecedents, ',')) FROM c
WHERE antecedents IN (SELECT antecedents FROM c WHERE ac >= 0.01 * n)""")
def _(spark, sf_dir):
    df = rules_input(spark, sf_dir)
    return miners.mine_stats(df, "status", ["univar", "apriori"], CONFIG)[0].select("antecedents", "consequents", "observations", "rule_depth")


def _mined(name):
    def run(spark, sf_dir):
        df = rules_input(spark, sf_dir)
        found = {"cart": lambda: miners.mine_cart(df, "status"), "rulefit": lambda: miners.mine_rulefit(df, "status"), "cn2": lambda: miners.mine_cn2(df, "status"), "elcs": lambda: miners.mine_elcs(df, "status")}[name]()
        return rounded(rules.rule_stats(df, sorted({tuple(rules.normalize_rule(r)) for r in found}), "status"))

    return run


for _m in ("cart", "rulefit", "cn2", "elcs"):
    query(f"{_m}_rules")(_mined(_m))


@query("skewed_proportions", "WITH c AS (SELECT event_type AS target, pow(sum(count(*)) OVER () / count(*), 1.5) AS w FROM events GROUP BY event_type) SELECT target, round(w / sum(w) OVER (), 6) AS proportion FROM c")
def _(spark, sf_dir):
    return rounded(synth.generate_skewed_proportions(table(spark, sf_dir, "events"), "event_type"))


@query("coalesce_union", "SELECT event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 3 = 0")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return synth.coalesce_data(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"))


@query("class_imbalance")
def _(spark, sf_dir):
    return synth.apply_class_imbalance(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type")


@query("flip_features")
def _(spark, sf_dir):
    return synth.flip_boolean_values(rules_input(spark, sf_dir).withColumn("big", F.col("big") == 1), ["big"], 0.2)


@query("flip_labels")
def _(spark, sf_dir):
    return synth.flip_labels(rules_input(spark, sf_dir), "status", 0.2)


@query("copula")
def _(spark, sf_dir):
    return rounded(synth.generate_synthetic_data(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), 2000)[0])


_SPAN = "s AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events)"


@query("time_splits", f"""WITH {_SPAN}, k AS (SELECT event_id, least(3, CAST(floor(epoch_us(ts - lo) * 4.0 / epoch_us(hi - lo)) AS INT)) AS split FROM events, s)
SELECT split, count(*) AS n_rows FROM k GROUP BY split""")
def _(spark, sf_dir):
    return splits.generate_time_splits(table(spark, sf_dir, "events"), "ts", 4)[1].select("split", "n_rows")


@query("range_splits", """SELECT 0 AS split, count(*) AS n_rows FROM events WHERE ts >= '2024-01-02' AND ts < '2024-01-05' UNION ALL SELECT 1, count(*) FROM events WHERE ts >= '2024-01-04' AND ts < '2024-01-09'""")
def _(spark, sf_dir):
    return splits.generate_time_splits(table(spark, sf_dir, "events"), "ts", date_ranges=[["2024-01-04", "2024-01-09"], ["2024-01-02", "2024-01-05"]])[1].select("split", "n_rows")


@query("fraction_splits", f"""WITH {_SPAN}, p AS (SELECT epoch_us(ts - lo) * 1.0 / epoch_us(hi - lo) AS f FROM events, s)
SELECT 0 AS split, count(*) FILTER (f < 0.6) AS n_rows FROM p UNION ALL SELECT 1, count(*) FILTER (f >= 0.6) FROM p""")
def _(spark, sf_dir):
    return splits.generate_fraction_splits(table(spark, sf_dir, "events"), "ts", fractions=[0.6, 0.4])[1].select("split", "n_rows")




_HALF_RULES = RULES.replace("FROM lineitem", "FROM lineitem WHERE {}")


def _part(spark, sf_dir, late: bool):
    li = table(spark, sf_dir, "lineitem").filter((F.col("l_orderkey") % 2 == 1) if late else (F.col("l_orderkey") % 2 == 0))
    return li.select((F.col("l_quantity") > 25).cast("int").alias("big"), (F.col("l_discount") >= 0.05).cast("int").alias("discounted"), (F.col("l_returnflag") == "A").cast("int").alias("returned"), (F.col("l_extendedprice") > 50000).cast("int").alias("dear"), F.col("l_linestatus").alias("status"))


def _part_metrics(odd: int) -> str:
    return f"WITH {_HALF_RULES.format(f'l_orderkey % 2 = {odd}')}, {_LONG}, {_COUNTS} {metrics_sql('c')}"


_COMBINED = f"SELECT antecedents, consequents, a.lift AS split_0_lift, b.lift AS split_1_lift, a.confidence AS split_0_confidence, b.confidence AS split_1_confidence, a.observations AS split_0_observations, b.observations AS split_1_observations, a.support AS sa, b.support AS sb FROM ({_part_metrics(0)}) a FULL JOIN ({_part_metrics(1)}) b USING (antecedents, consequents)"


def _combined(spark, sf_dir):
    return validate.combine_split_results([stats.generate_statistics(_part(spark, sf_dir, late), CONFIG)[0] for late in (False, True)])


@query("combine_splits", f"SELECT antecedents, consequents, split_0_lift, split_1_lift FROM ({_COMBINED})")
def _(spark, sf_dir):
    return rounded(_combined(spark, sf_dir).select("antecedents", "consequents", "split_0_lift", "split_1_lift"))


_S0, _S1 = (f"coalesce({s} >= 0.05 AND (split_{i}_lift <= 0.99 OR split_{i}_lift >= 1.01) AND split_{i}_observations >= 20, false)" for i, s in enumerate(("sa", "sb")))


@query("validation_log", f"""WITH c AS (SELECT *, {_S0} AS s0, {_S1} AS s1 FROM ({_COMBINED}))
SELECT 'split_0' AS split, count(split_0_lift) AS n_rules, count(*) FILTER (s0) AS n_selected, round(avg(split_0_lift) FILTER (s0), 4) AS mean_lift, count(*) FILTER (s0 AND s1) AS overlap FROM c
UNION ALL SELECT 'split_1', count(split_1_lift), count(*) FILTER (s1), round(avg(split_1_lift) FILTER (s1), 4), count(*) FILTER (s0 AND s1) FROM c""")
def _(spark, sf_dir):
    return rounded(validate.create_validation_log_df(_combined(spark, sf_dir), ["split_0", "split_1"]).select("split", "n_rules", "n_selected", "mean_lift", "overlap"), 4)


#: Events as a table of rule metrics over replicates: the type as rule, the user as class.
_METRIC_EVENTS = "m AS (SELECT event_type AS antecedents, CAST(user_id % 5 AS VARCHAR) AS consequents, value AS lift, event_id % 3 = 0 AS selected, event_id // 100 AS permutation FROM events)"


def _metric_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("antecedents"), (F.col("user_id") % 5).cast("string").alias("consequents"), F.col("value").alias("lift"), (F.col("event_id") % 3 == 0).alias("selected"), F.floor(F.col("event_id") / 100).alias("permutation"))


@query("bootstrap_summary", f"""WITH {_METRIC_EVENTS} SELECT antecedents, consequents, round(avg(lift), 5) AS lift_mean, round(stddev_samp(lift), 5) AS lift_std, min(lift) AS lift_min, max(lift) AS lift_max, round(quantile_cont(lift, 0.05), 5) AS lift_q05, round(quantile_cont(lift, 0.95), 5) AS lift_q95,
count(*) FILTER (selected) AS selected_sum, count(*) AS selected_count, round(count(*) FILTER (selected) / count(*), 5) AS selected_fraction FROM m GROUP BY ALL""")
def _(spark, sf_dir):
    return rounded(validate.summarize_rule_metrics(_metric_events(spark, sf_dir), ["lift"]), 5)


@query("validation_summary", f"""WITH {_METRIC_EVENTS}, s AS (SELECT avg(lift) AS x, count(*) FILTER (selected) / count(*) AS f FROM m GROUP BY antecedents, consequents)
SELECT count(*) AS n_rules, round(avg(f), 5) AS selected_fraction_mean, round(avg(x), 5) AS lift_mean, round(stddev_samp(x), 5) AS lift_std, round(min(x), 5) AS lift_min, round(max(x), 5) AS lift_max FROM s""")
def _(spark, sf_dir):
    return rounded(validate.create_validation_summary_log(validate.summarize_rule_metrics(_metric_events(spark, sf_dir), ["lift"]), ["lift"]), 5)


@query("null_summary", f"""WITH {_METRIC_EVENTS} SELECT round(avg(lift), 5) AS mean, round(stddev_samp(lift), 5) AS std, min(lift) AS min, max(lift) AS max, round(quantile_cont(lift, 0.05), 5) AS q05, round(quantile_cont(lift, 0.5), 5) AS q50, round(quantile_cont(lift, 0.95), 5) AS q95, count(DISTINCT permutation) AS n_permutations, count(lift) AS n_obs FROM m""")
def _(spark, sf_dir):
    return rounded(validate.summarize_null_distribution(_metric_events(spark, sf_dir), "lift", "permutation"), 5)


@query("relative_error", "WITH r AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 200) SELECT round(stddev_samp(value) / avg(value), 5) AS error FROM r")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(spark.createDataFrame([(validate.compute_relative_error(e, "value", "event_id", 200),)], "error double"), 5)


def _actual_null(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("value").alias("lift")), table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 10007 / 100.0).alias("lift"))


#: Each level of the null values with the share at or below and at or above it.
_ACTUAL = "a AS (SELECT event_id, value AS lift FROM events), z AS (SELECT o_orderkey * 7919 % 10007 / 100.0 AS lift FROM orders), n AS (SELECT count(*) AS n, median(lift) AS m FROM z)"
_P = {"greater": ("lift", ">="), "less": ("lift", "<="), "two_sided": ("abs(lift - m)", ">=")}


def _pval_sql(value, sign):
    """Counts by an ordered union of both tables, each null value once."""
    order = "DESC" if sign == ">=" else "ASC"
    return f"""WITH {_ACTUAL}, u AS (SELECT event_id, {value} AS v, 0 AS k FROM a, n UNION ALL SELECT NULL, {value}, 1 FROM z, n),
c AS (SELECT event_id, sum(k) OVER (ORDER BY v {order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM u)
SELECT event_id, round(below / n, 6) AS pval FROM c, n WHERE event_id IS NOT NULL"""


for _k, _v in _P.items():

    @query(f"empirical_pvals_{_k}", _pval_sql(*_v))
    def _(spark, sf_dir, k=_k):
        actual, null = _actual_null(spark, sf_dir)
        return rounded(validate.compute_empirical_pvals(actual, null, "lift", k).select("event_id", "pval"))


_PVALS = "p AS (SELECT event_id, (event_id * 37 % 1000 + 1) / 20000.0 AS pval FROM events)"


def _pvals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 % 1000 + 1) / F.lit(20000.0)).alias("pval"))


def _adjusted(factor):
    return f"""WITH {_PVALS}, r AS (SELECT event_id, pval, rank() OVER (ORDER BY pval) + count(*) OVER (PARTITION BY pval) - 1 AS k, count(*) OVER () AS m FROM p), f AS (SELECT *, pval * m * {factor} / k AS raw FROM r)
SELECT event_id, round(least(1, min(raw) OVER (ORDER BY pval DESC)), 6) AS adjusted FROM f"""


@query("fdr_bh", _adjusted("1"))
def _(spark, sf_dir):
    return rounded(validate.adjust_pvals(_pvals(spark, sf_dir), "pval", "fdr_bh", "adjusted").select("event_id", "adjusted"))


@query("fdr_by", _adjusted("(SELECT sum(1.0 / i) FROM (SELECT row_number() OVER () AS i FROM p))"))
def _(spark, sf_dir):
    return rounded(validate.adjust_pvals(_pvals(spark, sf_dir), "pval", "fdr_by", "adjusted").select("event_id", "adjusted"))


@query("fdr_summary", f"""WITH {_PVALS} SELECT event_id % 3 AS grp, count(*) AS n_tests, count(*) FILTER (pval <= 0.05) AS n_raw_significant, count(*) FILTER (event_id % 4 = 0) AS n_fdr_significant, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0 END), 6) AS fdr_fraction, round(min(pval), 6) AS min_pval, round(median(pval), 6) AS median_pval, round(max(pval), 6) AS max_pval FROM p GROUP BY ALL""")
def _(spark, sf_dir):
    df = _pvals(spark, sf_dir).withColumn("fdr_significant", F.col("event_id") % 4 == 0).withColumn("grp", F.col("event_id") % 3)
    return rounded(validate.summarize_fdr_results(df, groupby_col="grp"))


@query("bootstrap_replicates")
def _(spark, sf_dir):
    return rounded(validate.bootstrap_stats(rules_input(spark, sf_dir), [sorted(r) for r in RULE_LIST], "status", 1000))


@query("null_permutations")
def _(spark, sf_dir):
    return rounded(validate.null_stats(rules_input(spark, sf_dir), [sorted(r) for r in RULE_LIST], "status", range(50)))


@query("fdr_pipeline_rules")
def _(spark, sf_dir):
    df, mined = _rules(spark, sf_dir)
    null, _summary = validate.validate_null(df, mined.withColumn("selected", F.lit(True)), "status")
    return rounded(validate.validate_multiple_tests(mined, null))
