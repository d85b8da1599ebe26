"""Queries on whole stages, on operators that stages are made of, and on what random draws must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import make_config
from ..operators import features, miners, rules, scale, splits, synth, types, validate
from ..plans import stages
from ..sources import tables
from ..sources.shared import scratch
from .base import EVENTS, FEATURES, RULES, events, query, rounded, rules_input, table
from .mining import _LONG, _METRICS, _RULE_METRICS, _SELECTED, CONFIG, FILTERS, RULE_LIST, _part, _part_metrics, _rules, _text

SETTINGS = {"id_cols": [], "date_col": "none", "target_col": "status", "drop_cols": [], "to_sample": False} | FILTERS
#: Runs over events as a panel: the user as id, the time as date.
PANEL = {"id_cols": ["user_id"], "date_col": "ts"}


def _config(settings: dict):
    return make_config(None, settings)


# --- stages -----------------------------------------------------------------


@query("clean_chain", f"""WITH {EVENTS}, filled AS (SELECT event_id, coalesce(x, median(x) OVER (PARTITION BY user_id)) AS x FROM panel)
SELECT event_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 5) + 0.0 AS x FROM filled""")
def _(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "user_id", "ts", "x")
    out, _logs = stages.clean_pipeline(df, _config(PANEL | {"to_drop_high_missingness": False, "to_drop_var": False, "to_drop_corr": False, "max_imputed": 1.0, "scale_cols": ["x"]}))
    return rounded(out.select("event_id", "x"), 5)


_QUARTERS = "edges AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)"
_QUARTER = "CASE WHEN value <= a THEN 'q1' WHEN value <= b THEN 'q2' WHEN value <= c THEN 'q3' ELSE 'q4' END"


def _quartered(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")


def _one_hot_counts(df):
    """name, n of binary columns, keys left out."""
    names = [c for c in df.columns if c not in ("user_id", "ts")]
    return df.agg(*[F.sum(F.col(f"`{c}`").cast("long")).alias(f"_{i}") for i, c in enumerate(names)]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_{i}").alias("n")) for i, c in enumerate(names)])).alias("e")
    ).select("e.*")


_ONE_HOT = f"""WITH {_QUARTERS} SELECT 'value=' || {_QUARTER} AS name, count(*) AS n FROM events, edges GROUP BY ALL
UNION ALL SELECT 'event_type=' || event_type, count(*) FROM events GROUP BY ALL"""


@query("encode_data", _ONE_HOT)
def _(spark, sf_dir):
    return _one_hot_counts(features.encode_data(_quartered(spark, sf_dir), "ts", ["user_id"], bin_quantile_labels=["q1", "q2", "q3", "q4"]))


@query("engineer_chain", _ONE_HOT)
def _(spark, sf_dir):
    settings = PANEL | {"to_engineer_ratios": False, "to_engineer_lags": False, "bin_quantile_labels": ["q1", "q2", "q3", "q4"]}
    return _one_hot_counts(stages.engineer_pipeline(_quartered(spark, sf_dir), _config(settings)))


@query("target_chain", """WITH clicks AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
views AS (SELECT user_id, ts, lead(value) OVER (PARTITION BY user_id ORDER BY ts) / value - 1 AS r FROM events WHERE event_type = 'view'),
m AS (SELECT c.event_id, v.r FROM clicks c ASOF JOIN views v ON c.user_id = v.user_id AND c.ts <= v.ts)
SELECT event_id, CASE WHEN r <= 0 THEN 'down' ELSE 'up' END AS forward_return FROM m WHERE r IS NOT NULL""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    prices = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("adj_close"))
    settings = PANEL | {"target_periods": 1, "target_bins": [-float("inf"), 0.0, float("inf")], "target_labels": ["down", "up"]}
    out, _logs = stages.target_pipeline(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), _config(settings), prices)
    return out.select("event_id", "forward_return")


@query("data_prep_chain", f"WITH {RULES} SELECT DISTINCT big, discounted, returned, dear, status FROM input")
def _(spark, sf_dir):
    return stages.data_prep_pipeline(rules_input(spark, sf_dir), _config(SETTINGS | {"drop_duplicates": True}))[0]


@query("mining_chain", f"SELECT *, {_SELECTED} AS selected FROM ({_METRICS})")
def _(spark, sf_dir):
    out, _counts = stages.mining_pipeline(rules_input(spark, sf_dir), _config(SETTINGS | {"miners": ["univar"]}))
    return rounded(out.drop("rule_depth", "source", "human_readable_rule"))


_LOOSE = FILTERS | {"stat_bounds_lift": [0.9999, 1.0001]}
_LOOSELY = _SELECTED.replace("0.99 OR", "0.9999 OR").replace("1.01", "1.0001")


@query("retest_rules", f"SELECT r.antecedents, r.consequents, r.lift, r.observations FROM ({_part_metrics(1)}) r WHERE r.antecedents IN (SELECT antecedents FROM ({_part_metrics(0)}) WHERE {_LOOSELY})")
def _(spark, sf_dir):
    from ..operators import stats

    train = stats.generate_statistics(_part(spark, sf_dir, False), CONFIG | _LOOSE)[0]
    return rounded(validate.test_mined_rules(train, _part(spark, sf_dir, True), CONFIG | _LOOSE, "status").select("antecedents", "consequents", "lift", "observations"))


@query("split_mining_chain", f"""SELECT 0 AS split, antecedents, consequents, lift, observations FROM ({_part_metrics(0)}) UNION ALL
SELECT 1, r.antecedents, r.consequents, r.lift, r.observations FROM ({_part_metrics(1)}) r WHERE r.antecedents IN (SELECT antecedents FROM ({_part_metrics(0)}) WHERE {_LOOSELY})""")
def _(spark, sf_dir):
    parts = [_part(spark, sf_dir, late) for late in (False, True)]
    both = stages.split_mining_pipeline(parts, _config(SETTINGS | _LOOSE | {"miners": ["univar"]}), False, "status")
    out = [rounded(d.select("antecedents", "consequents", "lift", "observations")).select(F.lit(i).alias("split"), "*") for i, d in enumerate(both)]
    return out[0].unionByName(out[1])


def _run_input(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = [F.when(F.col("event_type") == k, F.col("value")).otherwise(F.col("value") / 2).alias(f"f_{k}") for k in ("click", "view")]
    return e.select("user_id", "ts", *kinds), e.select("user_id", "ts", (F.col("value") + 1).alias("adj_close"))


_RUN = PANEL | {
    "miners": ["univar"], "to_engineer_lags": False, "to_drop_corr": False, "target_periods": 2, "stat_min_support": 0.0, "stat_bounds_lift": [1.0, 1.0], "stat_min_observations": 0,
    "bin_quantile_labels": ["q1", "q2", "q3", "q4"], "target_bins": [-float("inf"), 0.0, float("inf")], "target_labels": ["down", "up"],
}


@query("train_test_chain")
def _(spark, sf_dir):
    combined, _log, _cut = stages.validate_train_test(*_run_input(spark, sf_dir), _config(_RUN))
    return rounded(combined.select("antecedents", "consequents", "split_0_lift", "split_1_lift"))


@query("train_test_log")
def _(spark, sf_dir):
    return rounded(stages.train_test_pipeline(*_run_input(spark, sf_dir), _config(_RUN))[1])


@query("walk_forward_chain")
def _(spark, sf_dir):
    settings = _RUN | {"wfa_split_method": "fractional"}
    combined, _log, _cut = stages.validate_wfa(*_run_input(spark, sf_dir), _config(settings))
    return rounded(combined.select("antecedents", "consequents", "split_0_lift", "split_1_lift"))


@query("walk_forward_log")
def _(spark, sf_dir):
    return rounded(stages.wfa_pipeline(*_run_input(spark, sf_dir), _config(_RUN | {"wfa_split_method": "fractional"}))[1])


# --- replicates: what any draw must keep --------------------------------------

_WHOLE = f"SELECT antecedents, consequents, observations FROM ({_RULE_METRICS})"


@query("bootstrap_chain", f"SELECT antecedents, consequents, CAST(observations AS BIGINT) AS observations, 200 AS replicates, true AS near, true AS spread FROM ({_WHOLE})")
def _(spark, sf_dir):
    df, mined = _rules(spark, sf_dir)
    cfg = _config(SETTINGS | {"n_bootstrap": 200, "stat_min_support": -1.0})
    summary, _log = stages.bootstrap_pipeline(df, mined.withColumn("selected", F.lit(True)), cfg)
    both = mined.select("antecedents", "consequents", F.col("observations").alias("n")).join(summary, ["antecedents", "consequents"])
    # a Poisson total of n rows has variance n; the mean of 200 of them one of n / 200
    near = F.abs(F.col("observations_mean") - F.col("n")) <= 6 * F.sqrt(F.col("n") / 200) + 0.5
    spread = (F.col("observations_std") > 0.7 * F.sqrt("n")) & (F.col("observations_std") < 1.3 * F.sqrt("n"))
    return both.select("antecedents", "consequents", F.col("n").cast("long").alias("observations"), F.col("selected_count").cast("int").alias("replicates"), near.alias("near"), spread.alias("spread"))


@query("null_chain", f"""WITH m AS ({_RULE_METRICS}) SELECT antecedents, consequents, round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support, true AS kept, true AS near FROM m""")
def _(spark, sf_dir):
    df, mined = _rules(spark, sf_dir)
    null, _log = stages.null_pipeline(df, mined.withColumn("selected", F.lit(True)), _config(SETTINGS | {"n_null": 100}))
    # shuffling the classes keeps how many rows meet a rule and how many are of a class, and makes both independent
    kept = (F.min("antecedent_support") == F.max("antecedent_support")) & (F.min("consequent_support") == F.max("consequent_support"))
    near = F.abs(F.avg("lift") - 1) < 6 * F.stddev_samp("lift") / F.sqrt(F.count("lift")) + 1e-6
    return rounded(null.groupBy("antecedents", "consequents").agg(F.max("antecedent_support").alias("antecedent_support"), F.max("consequent_support").alias("consequent_support"), kept.alias("kept"), near.alias("near")))


# --- random changes: what they keep and how much they change -------------------

def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), (F.col("value") > 20).alias("big"))


def _changed(before, after, c):
    """n rows of both under the same key, and the share of those whose column differs."""
    both = before.select("event_id", F.col(c).alias("_was")).join(after, "event_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_was") != F.col(c)).cast("int")).alias("share"))


@query("flip_features_kept", "SELECT count(*) AS n, true AS near FROM events")
def _(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return _changed(df, synth.flip_boolean_values(df, ["big"], 0.2), "big").select("n", (F.abs(F.col("share") - 0.2) < 0.02).alias("near"))


@query("flip_labels_kept", "SELECT count(*) AS n, true AS near FROM events")
def _(spark, sf_dir):
    df = _labelled(spark, sf_dir)  # of five labels a fifth of the redrawn ones stay
    return _changed(df, synth.flip_labels(df, "status", 0.2), "status").select("n", (F.abs(F.col("share") - 0.16) < 0.02).alias("near"))


@query("class_imbalance_kept", "SELECT event_type, count(*) AS before, true AS near, 0 AS unknown FROM events GROUP BY event_type")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    n = df.count()
    wanted = synth.generate_skewed_proportions(df, "event_type").select(F.col("target").alias("event_type"), (F.col("proportion") * n).alias("wanted"))
    made = synth.apply_class_imbalance(df, "event_type")
    unknown = made.join(df, ["event_id", "event_type"], "left_anti").count()
    after = made.groupBy("event_type").agg(F.count(F.lit(1)).alias("after"))
    counts = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("before")).join(wanted, "event_type").join(after, "event_type")
    return counts.select("event_type", "before", (F.abs(F.col("after") - F.col("wanted")) < 6 * F.sqrt("wanted") + 1).alias("near"), F.lit(unknown).cast("int").alias("unknown"))


@query("augment_kept", "SELECT count(*) AS n, true AS labels, true AS features FROM events")
def _(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    made = synth.augment_dataset(df, "status", to_aug_flip_feats=True, to_aug_flip_targets=True, flip_feats_frac=0.1, flip_targs_frac=0.1)
    both = _changed(df, made, "status").select("n", (F.abs(F.col("share") - 0.08) < 0.02).alias("labels"))
    return both.crossJoin(F.broadcast(_changed(df, made, "big").select((F.abs(F.col("share") - 0.1) < 0.02).alias("features"))))


@query("prep_sample", f"WITH {RULES}, c AS (SELECT status, count(*) AS k, sum(count(*)) OVER () AS n FROM input GROUP BY status) SELECT status, CAST(round(k * 5000.0 / n) AS BIGINT) AS n_rows FROM c")
def _(spark, sf_dir):
    out, _log = miners.prepare_dataframe_for_mining(rules_input(spark, sf_dir), "", [], [], "status", sample_size=5000)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@query("shuffle_target", "SELECT event_type AS status, count(*) AS n, sum(count(*)) OVER () AS n_rows, true AS moved FROM events GROUP BY event_type")
def _(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    made = validate.shuffle_dataframe(df, "target", "status", 7)
    counts = made.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # of a random order as many rows change their class as independence lets expect
    total = counts.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    moved = _changed(df, made, "status").select("share")
    facts = total.crossJoin(F.broadcast(moved)).select("n_rows", (F.abs(F.col("share") - (1 - F.col("squares") / (F.col("n_rows") * F.col("n_rows")))) < 0.02).alias("moved"))
    return counts.crossJoin(F.broadcast(facts))


def _blocks(df, made, keys, size):
    """n rows, and whether the sample is made of runs: places where a run can begin are at most its blocks."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ts", "event_id", "value") if keys else Window.orderBy("_row")
    times = made.groupBy("event_id").agg(F.count(F.lit(1)).alias("_times"))
    order = df.join(times, "event_id", "left").select(*keys, "event_id", "ts", "value", *([] if keys else ["_row"]), F.coalesce("_times", F.lit(0)).alias("_times"))
    if keys:
        rise = order.withColumn("_rise", F.greatest(F.col("_times") - F.coalesce(F.lag("_times").over(w), F.lit(0)), F.lit(0)))
        return rise.groupBy(*keys).agg(F.sum("_times").alias("n"), (F.sum("_rise") <= F.ceil(F.count(F.lit(1)) / size)).alias("runs"))
    before = order.select((F.col("_row") + 1).alias("_row"), F.col("_times").alias("_before"))
    rise = order.join(before, "_row", "left").withColumn("_rise", F.greatest(F.col("_times") - F.coalesce("_before", F.lit(0)), F.lit(0)))
    return rise.agg(F.sum("_times").alias("n"), (F.sum("_rise") <= F.ceil(F.count(F.lit(1)) / size)).alias("runs"))


@query("resample_block", "SELECT count(*) AS n, true AS runs FROM events")
def _(spark, sf_dir):
    from ..operators.grouping import global_row_number

    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return _blocks(global_row_number(e, ["ts", "event_id", "value"], "_row"), validate.resample_dataframe(e, "block", 10, "ts"), [], 10)


@query("resample_block_ids", "SELECT user_id, count(*) AS n, true AS runs FROM events GROUP BY user_id")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return _blocks(e, validate.resample_dataframe(e, "block_ids", 5, "ts", ["user_id"]), ["user_id"], 5)


@query("combined_synthetic", "SELECT 4000 AS n, true AS numbers, true AS texts")
def _(spark, sf_dir):
    real = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    made = synth.generate_combined_synthetic_data(real, to_sdv=True, sdv_rows=4000)
    a, b = (d.agg(F.avg("l_quantity").alias("q"), F.corr("l_quantity", "l_extendedprice").alias("c"), F.avg((F.col("l_returnflag") == "A").cast("int")).alias("s"), F.count(F.lit(1)).alias("n")) for d in (real, made))
    both = a.crossJoin(F.broadcast(b.toDF("mq", "mc", "ms", "mn")))
    return both.select(F.col("mn").cast("int").alias("n"), ((F.abs(F.col("mq") - F.col("q")) < 2) & (F.abs(F.col("mc") - F.col("c")) < 0.1)).alias("numbers"), (F.abs(F.col("ms") - F.col("s")) < 0.05).alias("texts"))


# --- smaller operators -----------------------------------------------------------

_FORMS = [
    ("yyyy-MM-dd HH:mm:ss.SSS", "date_trunc('second', ts) + INTERVAL 123 MILLISECOND"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "date_trunc('second', ts)"),
    ("yyyy-MM-dd HH:mm:ss'+02:00'", "date_trunc('second', ts) - INTERVAL 2 HOUR"),
    ("yyyy-MM-dd HH:mm:ss'-0530'", "date_trunc('second', ts) + INTERVAL 330 MINUTE"),
    ("yyyy-MM-dd HH:mm", "date_trunc('minute', ts)"),
    ("MMM d, yyyy", "date_trunc('day', ts)"),
    ("dd-MMM-yyyy", "date_trunc('day', ts)"),
    ("MM/dd/yyyy HH:mm:ss", "date_trunc('second', ts)"),
]


@query("parse_datetime_forms", "SELECT event_id, epoch_us(CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(_FORMS)) + " END) AS at FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.lit(None).cast("string")
    for i, (form, _sql) in enumerate(_FORMS):
        moment = F.date_trunc("second", "ts") + F.expr("INTERVAL '0.123' SECOND") if "SSS" in form else F.col("ts")
        text = F.when(F.col("event_id") % 8 == i, F.date_format(moment, form)).otherwise(text)
    out = types.parse_datetime_column(e.select("event_id", text.alias("at")), "at")
    return out.select("event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))


@query("clean_datetimes", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS at FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return types.clean_datetime_columns(e, {"datetime": ["at"]}).select("event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))


_SCALED = {
    "zscore": "(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0)",
    "unit_vector": "value / nullif(sqrt(sum(value * value) OVER w), 0)",
    "robust": "(value - quantile_cont(value, 0.5) OVER w) / nullif(quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w, 0)",
}
for _k, _v in _SCALED.items():

    @query(f"normalize_{_k}", f"SELECT event_id, round({_v}, 5) + 0.0 AS value FROM events WINDOW w AS (PARTITION BY user_id)")
    def _(spark, sf_dir, k=_k):
        e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
        return rounded(scale.normalize_features(e, k, ["value"], "ids", ["user_id"], "ts")[0].select("event_id", "value"), 5)


@query("rule_depths", f"SELECT DISTINCT antecedents, rule_depth FROM ({_RULE_METRICS})")
def _(spark, sf_dir):
    _df, mined = _rules(spark, sf_dir)
    texts = sorted(r[0] for r in mined.select("antecedents").distinct().collect())
    return spark.createDataFrame([(t, rules.compute_rule_depth(t)) for t in texts], "antecedents string, rule_depth int")


_TEXTS = ", ".join(f"('{f}', '{f} == 1')" for f in FEATURES)


@query("rule_feature_names", f"SELECT DISTINCT feature FROM (VALUES {_TEXTS}) AS t(feature, antecedents)")
def _(spark, sf_dir):
    from ..operators import stats

    m = stats.calculate_association_metrics(rules_input(spark, sf_dir), "status")
    return m.select(validate.extract_rule_feature_names(F.col("antecedents")).alias("feature")).distinct()


@query("rules_by_miner", "SELECT * FROM (VALUES ('x', 2), ('y', 1), ('z', 1)) AS t(source, n_rules)")
def _(spark, sf_dir):
    from .mining import _SOURCES

    return rules.count_rules_per_algorithm(rules.normalize_and_dedup_rules(rules.rules_table(spark, _SOURCES))[0]).select("source", F.col("n_rules").cast("int").alias("n_rules"))


@query("rules_on_other_data", "WITH " + RULES + " SELECT status, " + ", ".join("CAST(sum(CAST(" + " AND ".join(f"{f} = {v}" for f, v in r) + f" AS INT)) AS BIGINT) AS rule_{i:04d}" for i, r in enumerate(sorted(map(sorted, RULE_LIST), key=_text))) + " FROM input GROUP BY status")
def _(spark, sf_dir):
    df, mined = _rules(spark, sf_dir)
    active, texts = validate.make_combined_rule_feature_df(mined.withColumn("selected", F.lit("true")), df, "status")
    return active.groupBy("status").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in sorted(texts)])


@query("truth_of_columns", "SELECT count(*) FILTER (event_id % 4 IN (0, 1)) AS n_true, count(*) FILTER (event_id % 4 NOT IN (0, 1)) AS n_false FROM events")
def _(spark, sf_dir):
    spelled = F.element_at(F.array(F.lit(" True"), F.lit("1"), F.lit("no"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(validate.ensure_bool(spelled).alias("b"))
    return e.agg(F.count_if("b").alias("n_true"), F.count_if(~F.col("b")).alias("n_false"))


@query("saved_table", "SELECT event_id, user_id, round(value, 6) + 0.0 AS value FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rounded(tables.load_table(spark, tables.save_table(e, scratch(spark, "saved") + ".parquet")))


@query("split_parts", """WITH s AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), k AS (SELECT least(1, CAST(floor(epoch_us(ts - lo) * 2.0 / epoch_us(hi - lo)) AS INT)) AS split, value FROM events, s)
SELECT split, count(*) AS n, round(sum(value), 3) AS total FROM k GROUP BY split""")
def _(spark, sf_dir):
    parts, _log = splits.generate_time_splits(table(spark, sf_dir, "events"), "ts", 2)
    out = [p.agg(F.lit(i).alias("split"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")) for i, p in enumerate(parts)]
    return out[0].unionByName(out[1])
