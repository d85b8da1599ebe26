"""Out-of-sample tests, bootstrap, permutation nulls, corrections for many tests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import get_stat_registry
from ..functions.scalar import quoted
from ..sources.shared import saved
from .grouping import global_row_number, ranged
from .rules import Rule, condition, parse_rule_text, rule_stats, rule_text
from .stats import apply_statistic_filters, build_filter_config
from .synth import keyed, uniform

METRICS = tuple(get_stat_registry())
KEYS = ("antecedents", "consequents")


def rules_series_to_unique_rules(texts: Sequence[str], provenance: bool = False) -> list:
    """Rule texts to rules, each once in order; with provenance, (rule, texts)."""
    found: dict[tuple, list[str]] = {}
    for t in texts:
        found.setdefault(tuple(sorted(parse_rule_text(t))), []).append(t)
    return [(list(r), ts) for r, ts in found.items()] if provenance else [list(r) for r in found]


def extract_rule_feature_names(antecedents: Column) -> Column:
    """What stands before ``==``."""
    return F.trim(F.substring_index(antecedents, "==", 1))


def selected_rules(mining_res: DataFrame) -> list[Rule]:
    """The different rules of the rows marked selected."""
    rows = mining_res.filter(ensure_bool(F.col("selected"))).select("antecedents").distinct().collect()
    return rules_series_to_unique_rules(sorted(r[0] for r in rows))


def make_combined_rule_feature_df(train_mining_res: DataFrame, test_df: DataFrame, target_col: str) -> tuple[DataFrame, dict[str, str]]:
    """Activations of the selected rules on other data, and their texts."""
    rules = [r for r in selected_rules(train_mining_res) if all(f in test_df.columns for f, _ in r)]
    names = {f"rule_{i:04d}": r for i, r in enumerate(rules)}
    return test_df.select(*[condition(test_df, r).alias(n) for n, r in names.items()], quoted(target_col)), {n: rule_text(r) for n, r in names.items()}


def test_mined_rules(train_mining_res: DataFrame, test_df: DataFrame, cfg, target_col: str) -> DataFrame:
    """Statistics of the selected training rules on other data, single features among them; no rule gives no row."""
    rules = [r for r in selected_rules(train_mining_res) if all(f in test_df.columns for f, _ in r)]
    stats = rule_stats(test_df, rules, target_col)
    single = F.regexp_extract("antecedents", r"^\('(.*)' == ([01])\)$", 1)
    as_single = F.when(F.col("rule_depth") == 1, F.concat(single, F.lit(" == "), F.regexp_extract("antecedents", r"^\('(.*)' == ([01])\)$", 2))).otherwise(F.col("antecedents"))
    return apply_statistic_filters(stats.withColumn("antecedents", as_single), build_filter_config(cfg))[0]


test_mined_rules.__test__ = False  # not a test


def combine_split_results(results: Sequence[DataFrame], split_prefixes: Sequence[str] | None = None) -> DataFrame:
    """Full outer join of the splits' tables on rule and class (and depth), other columns prefixed."""
    if not results:
        raise ValueError("no results")
    prefixes = list(split_prefixes or (f"split_{i}" for i in range(len(results))))
    if len(prefixes) != len(results):
        raise ValueError("a prefix for each result is needed")
    keys = [k for k in (*KEYS, "rule_depth") if all(k in r.columns for r in results)]
    parts = [r.select(*keys, *[quoted(c).alias(f"{p}_{c}") for c in r.columns if c not in keys]) for r, p in zip(results, prefixes)]
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def ensure_bool(c: Column) -> Column:
    """Truth of booleans and of 'true' and '1'; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def create_validation_log_df(train_test_results: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """A row for each split: rules, selected ones, mean and median of metrics; overlap of the first two splits' selections."""
    if splits is None:
        splits = sorted({m[1] for c in train_test_results.columns if (m := re.fullmatch(r"(.+)_selected", c))})
    if not splits:
        raise ValueError("no splits")
    df, parts = train_test_results, []
    for s in splits:
        chosen_rows = ensure_bool(quoted(f"{s}_selected"))
        parts += [F.count(quoted(f"{s}_lift")).alias(f"{s}_n"), F.count_if(chosen_rows).alias(f"{s}_s")]
        for m in ("lift", "confidence", "observations"):
            x = quoted(f"{s}_{m}").cast("double") if f"{s}_{m}" in df.columns else F.lit(None).cast("double")
            parts += [F.avg(F.when(chosen_rows, x)).alias(f"{s}_mean_{m}"), F.median(F.when(chosen_rows, x)).alias(f"{s}_median_{m}")]
    if len(splits) > 1:
        a, b = (ensure_bool(quoted(f"{s}_selected")) for s in splits[:2])
        parts += [F.count_if(a & b).alias("_overlap"), F.avg(F.when(a & b, quoted(f"{splits[1]}_lift") - quoted(f"{splits[0]}_lift"))).alias("_delta")]
    else:
        parts += [F.lit(None).cast("bigint").alias("_overlap"), F.lit(None).cast("double").alias("_delta")]
    entry = lambda s: F.struct(F.lit(s).alias("split"), F.col(f"{s}_n").alias("n_rules"), F.col(f"{s}_s").alias("n_selected"), *[F.col(f"{s}_{k}_{m}").alias(f"{k}_{m}") for m in ("lift", "confidence", "observations") for k in ("mean", "median")], F.col("_overlap").alias("overlap"), F.col("_delta").alias("mean_lift_delta"))
    return df.agg(*parts).select(F.explode(F.array(*[entry(s) for s in splits])).alias("e")).select("e.*")


def resample_dataframe(df: DataFrame, mode: str, block_size: int = 5, date_col: str = "date", id_cols: Sequence[str] | None = None, random_state: int = 42) -> DataFrame:
    """A bootstrap sample of as many rows: single rows, moving blocks in date order, or such blocks by id.

    Rows are numbered, starts drawn by hash, and joined; nothing is collected.
    """
    if mode not in ("traditional", "block", "block_ids"):
        raise ValueError(f"unknown mode {mode!r}")
    if block_size < 1:
        raise ValueError("block_size must be positive")
    if mode == "block_ids":
        if not id_cols:
            raise ValueError("id columns are needed")
        ids = [quoted(c) for c in id_cols]
        w = Window.partitionBy(*ids)
        rest = [quoted(c) for c in df.columns if c not in {date_col, *id_cols}]
        numbered = df.withColumn("_row", F.row_number().over(w.orderBy(quoted(date_col), *rest)) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_who", F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in ids]))
    else:
        order = [date_col] if date_col in df.columns else [df.columns[0]]
        numbered = global_row_number(df, [*order, *[c for c in df.columns if c not in order]], "_row").withColumn("_who", F.lit(""))
        numbered = numbered.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    size = 1 if mode == "traditional" else block_size
    slots = numbered.select("_who", "_n", F.col("_row").alias("_slot"))
    most = F.greatest(F.col("_n") - size + 1, F.lit(1))
    start = F.floor(uniform(F.concat_ws(":", "_who", F.floor(F.col("_slot") / size)), random_state) * most)
    slots = slots.select(F.col("_who").alias("_w"), (start + F.col("_slot") % size).alias("_from"))
    return slots.join(numbered, (slots["_w"] == numbered["_who"]) & (slots["_from"] == numbered["_row"])).select(*[quoted(c) for c in df.columns])


def summarize_rule_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """By rule and class: mean, std, min, max, 5 % and 95 % quantile of metrics; times and share selected."""
    parts = []
    for m in metrics:
        x = quoted(m).cast("double")
        parts += [F.avg(x).alias(f"{m}_mean"), F.stddev_samp(x).alias(f"{m}_std"), F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max"), F.percentile(x, 0.05).alias(f"{m}_q05"), F.percentile(x, 0.95).alias(f"{m}_q95")]
    picked = ensure_bool(F.col("selected"))
    parts += [F.count_if(picked).alias("selected_sum"), F.count(F.lit(1)).alias("selected_count"), F.avg(picked.cast("double")).alias("selected_fraction")]
    return df.groupBy(*KEYS).agg(*parts)


def create_validation_summary_log(summary_df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: rules, and mean, std, min and max of the metrics' means."""
    parts = [F.count(F.lit(1)).alias("n_rules"), F.avg("selected_fraction").alias("selected_fraction_mean")]
    parts += [f(quoted(f"{m}_mean")).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return summary_df.agg(*parts)


#: Parts into which different activation patterns are dealt by their hash.
PATTERN_PARTS = 256


def _patterns(df: DataFrame, rules: Sequence[Rule], target_col: str, block: Column | None = None) -> DataFrame:
    """pattern (a text of 0 and 1, a place for each rule), target, block, n, part: the table as replicates need it."""
    bits = F.concat(F.lit(""), *[F.when(condition(df, r), "1").otherwise("0") for r in rules])
    target = F.coalesce(quoted(target_col).cast("string"), F.lit("null"))
    flat = df.select(bits.alias("pattern"), target.alias("target"), (block.cast("string") if block is not None else F.lit("")).alias("block"))
    counted = flat.groupBy("pattern", "target", "block").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(PATTERN_PARTS)).cast("int"))


def _seeds(*what) -> np.random.Generator:
    return np.random.default_rng(np.frombuffer(hashlib.blake2b("\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64))


def _bits(patterns) -> np.ndarray:
    """Pattern by rule."""
    return np.array([np.frombuffer(p.encode(), np.uint8) for p in patterns]).reshape(len(patterns), -1) == 48 + 1


def _totals(sums: dict[str, np.ndarray], rows: dict[str, np.ndarray], replicates: Sequence[int]):
    """Sums of weights by class, replicate and rule (the last place: all rows) as a long frame without zeros."""
    import pandas as pd

    parts = []
    for target, table in sums.items():
        both = np.concatenate([table, rows[target][:, None]], axis=1)
        r, i = np.nonzero(both)
        parts.append(pd.DataFrame({"target": target, "replicate": np.asarray(replicates)[r], "rule": i, "a": both[r, i].astype(np.int64)}))
    return pd.concat(parts) if parts else pd.DataFrame({"target": [], "replicate": [], "rule": [], "a": []})


_TOTALS = "target string, replicate long, rule int, a long"


def _replicate_metrics(partial: DataFrame, rules: Sequence[Rule], classes: DataFrame, replicates: Sequence[int], copies: str) -> DataFrame:
    """Metrics of every rule, class and replicate from sums of weights; a class without weight in a replicate has zeros."""
    spark = partial.sparkSession
    summed = partial.groupBy("target", "replicate", "rule").agg(F.sum("a").alias("a"))
    texts = spark.createDataFrame([(i, rule_text(r)) for i, r in enumerate(rules)], "rule int, antecedents string")
    runs = spark.createDataFrame([(int(k),) for k in replicates], "replicate long")
    # rules, classes and replicates are the result itself
    grid = texts.join(runs).join(classes)
    rows = grid.join(summed, ["rule", "replicate", "target"], "left")
    whole = summed.filter(F.col("rule") == len(rules)).select("replicate", "target", F.col("a").alias("target_total"))
    each = Window.partitionBy("replicate", "rule")  # a row for each class
    counts = rows.join(whole, ["replicate", "target"], "left").select(
        "antecedents", F.col("target").alias("consequents"), F.col("replicate").alias(copies), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("target_total", F.lit(0)).alias("target_total"),
        F.sum(F.coalesce("a", F.lit(0))).over(each).alias("antecedent_total"), F.sum(F.coalesce("target_total", F.lit(0))).over(each).alias("total"),
    )
    return _metrics_of(counts, copies)


def _metrics_of(counts: DataFrame, copies: str) -> DataFrame:
    registry = get_stat_registry()
    a, with_condition, n_class, n = (F.col(c).cast("double") for c in ("a", "antecedent_total", "target_total", "total"))
    cells = {"a": a, "b": with_condition - a, "c": n_class - a, "d": n - with_condition - n_class + a, "target_total": n_class, "total": n}
    return counts.filter("total > 0").select("antecedents", "consequents", copies, *[f(cells).alias(k) for k, f in registry.items()])


def bootstrap_stats(df: DataFrame, rules: Sequence[Rule], target_col: str, n_bootstrap: int = 10, random_state: int = 42, block: Column | None = None) -> DataFrame:
    """Metrics of rules in each bootstrap replicate: replicate, antecedents, consequents, metrics.

    The table is read once and counted by activation pattern and class.  A
    replicate weighs each row by a Poisson(1) number, so a pattern of n rows by
    a Poisson(n) number, drawn from the pattern's content (each block of rows
    by one Poisson(1) number, if blocks are given); its row count varies around
    the table's.  A task holds the sums by class, replicate and rule.
    """
    if not rules or n_bootstrap < 1:
        raise ValueError("rules and replicates are needed")
    blocks = block is not None
    counted = saved(_patterns(df, rules, target_col, block), "patterns")

    def draw(frames):
        sums, rows = {}, {}
        for f in frames:
            bits = _bits(f["pattern"])
            weights = np.empty((len(f), n_bootstrap))
            for i, (pattern, target, name, n) in enumerate(zip(f["pattern"], f["target"], f["block"], f["n"])):
                weights[i] = n * _seeds(random_state, "block", name).poisson(1, n_bootstrap) if blocks else _seeds(random_state, pattern, target).poisson(n, n_bootstrap)
            for target in f["target"].unique():
                some = (f["target"] == target).to_numpy()
                sums[target] = sums.get(target, 0) + weights[some].T @ bits[some]
                rows[target] = rows.get(target, 0) + weights[some].sum(0)
        yield _totals(sums, rows, range(n_bootstrap))

    return _replicate_metrics(counted.mapInPandas(draw, _TOTALS), rules, counted.select("target").distinct(), range(n_bootstrap), "replicate")


def validate_bootstrap(df: DataFrame, mining_res: DataFrame, cfg, target_col: str, n_bootstrap: int = 10, random_state: int = 42, resample_method: str = "traditional", block_size: int = 5, date_col: str = "date", id_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The selected rules' metrics over bootstrap replicates, summed up by rule, and a one-row log."""
    rules = [r for r in selected_rules(mining_res) if all(f in df.columns for f, _ in r)]
    if not rules:
        raise ValueError("no selected rules")
    block = None
    if resample_method != "traditional":
        if resample_method == "block_ids":
            w = Window.partitionBy(*[quoted(c) for c in id_cols]).orderBy(quoted(date_col))
            df = df.withColumn("_block", F.concat_ws("\x1f", *[quoted(c).cast("string") for c in id_cols], F.floor((F.row_number().over(w) - 1) / block_size).cast("string")))
        else:
            df = global_row_number(df, [date_col, *[c for c in df.columns if c != date_col]], "_r").withColumn("_block", F.floor(F.col("_r") / block_size).cast("string"))
        block = F.col("_block")
    stats = apply_statistic_filters(bootstrap_stats(df, rules, target_col, n_bootstrap, random_state, block=block), build_filter_config(cfg))[0]
    summary = summarize_rule_metrics(stats, METRICS)
    return summary, create_validation_summary_log(summary, METRICS)


def shuffle_dataframe(df: DataFrame, mode: str = "target", target_col: str | None = None, random_state: int | None = None) -> DataFrame:
    """The table with its target, its rows, or each column permuted.

    A permutation joins row numbers in one random order with those in another.
    """
    seed = 0 if random_state is None else random_state
    if mode == "rows":
        return keyed(df).orderBy(uniform(F.col("_key"), seed), "_key").drop("_key")
    if mode not in ("target", "columns"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "target" and target_col not in df.columns:
        raise ValueError(f"no target column {target_col!r}")
    names = [target_col] if mode == "target" else list(df.columns)
    rows = saved(keyed(df), "keyed")
    base = global_row_number(rows, ["_key"], "_row")
    out = base.drop("_key", *names)
    for i, c in enumerate(names):
        drawn = rows.select(quoted(c), uniform(F.col("_key"), seed, i).alias("_u"), F.col("_key").alias("_key"))
        mixed = global_row_number(drawn, ["_u", "_key"], "_row").select(F.col("_row").alias("_other"), quoted(c))
        out = out.join(mixed, out["_row"] == mixed["_other"]).drop("_other")
    return out.select(*[quoted(c) for c in df.columns])


def compute_relative_error(df: DataFrame, metric_col: str, iteration_col: str, m_recent: int) -> float | None:
    """Deviation over mean of the metric in the last m rows by iteration; None where the mean is 0 or rows are too few."""
    last = df.select(quoted(metric_col).cast("double").alias("x"), quoted(iteration_col).alias("i")).orderBy(F.col("i").desc(), F.col("x")).limit(m_recent)
    n, mean, std = last.agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    return None if n < m_recent or not mean or std is None else abs(std / mean)


def summarize_null_distribution(null_df: DataFrame, metric_col: str, iteration_col: str) -> DataFrame:
    """One row: mean, std, min, max, quantiles, permutations and values."""
    x = quoted(metric_col).cast("double")
    quantiles = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    return null_df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *[F.percentile(x, q).alias(k) for k, q in quantiles.items()], F.count_distinct(quoted(iteration_col)).alias("n_permutations"), F.count(x).alias("n_obs"))


def null_stats(df: DataFrame, rules: Sequence[Rule], target_col: str, permutations: Sequence[int], random_state: int = 42) -> DataFrame:
    """Metrics of rules under permutations of the target: permutation, antecedents, consequents, metrics.

    A permutation of the labels deals the classes' rows at random to the
    activation patterns, so the counts are drawn as such: first for parts of
    the patterns (at the driver, PATTERN_PARTS numbers for a class and
    permutation), then for the patterns of a part, in a task.  The table is
    read once, and every draw depends on contents and seeds alone.
    """
    counted = saved(_patterns(df, rules, target_col), "patterns")
    permutations, parts = [int(k) for k in permutations], {r[0]: r[1] for r in counted.groupBy("part").agg(F.sum("n")).collect()}
    classes = sorted((r[0], r[1]) for r in counted.groupBy("target").agg(F.sum("n")).collect())
    names, order = [c for c, _ in classes], sorted(parts)
    shares = np.zeros((len(permutations), len(names), len(order)), np.int64)
    for k, permutation in enumerate(permutations):
        r, left = _seeds(random_state, "permutation", permutation), np.array([parts[p] for p in order], np.int64)
        for c, (_, n) in enumerate(classes):
            shares[k, c] = _deal(r, left, n)
            left = left - shares[k, c]

    def draw(key, f):
        part = order.index(int(key[0]))
        f = f.groupby("pattern", sort=True, as_index=False)["n"].sum()
        bits, size = _bits(f["pattern"]), f["n"].to_numpy()
        sums = {c: np.zeros((len(permutations), bits.shape[1])) for c in names}
        rows = {c: np.zeros(len(permutations)) for c in names}
        for k, permutation in enumerate(permutations):
            r, left = _seeds(random_state, "part", permutation, int(key[0])), size.copy()
            for c, name in enumerate(names):
                got = _deal(r, left, int(shares[k, c, part]))
                left = left - got
                sums[name][k], rows[name][k] = got @ bits, got.sum()
        return _totals(sums, rows, permutations)

    return _replicate_metrics(counted.groupBy("part").applyInPandas(draw, _TOTALS), rules, counted.select("target").distinct(), permutations, "permutation")


def _deal(r: np.random.Generator, boxes: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn without replacement from boxes of these sizes, come from each."""
    out, left, rest = np.zeros(len(boxes), np.int64), int(boxes.sum()), n
    for i, size in enumerate(boxes.tolist()):
        if not rest:
            break
        left -= size
        if size:
            out[i] = rest if not left else _hypergeometric(r, size, left, rest)
            rest -= int(out[i])
    return out


def _hypergeometric(r: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric number; the library's is limited to sums under 10**9, beyond that by the normal limit."""
    if good + bad < 10**9:
        return int(r.hypergeometric(good, bad, n))
    share = good / (good + bad)
    deviation = np.sqrt(n * share * (1 - share) * (good + bad - n) / (good + bad - 1))
    return int(min(max(round(r.normal(n * share, deviation)), n - bad, 0), good, n))


def validate_null(df: DataFrame, mining_res: DataFrame, target_col: str, n_null: int = 1000, early_stop_metric: str = "lift", es_m_permutations: int = 50, rel_error_threshold: float = 0.01, random_state: int = 42, save=None) -> tuple[DataFrame, DataFrame]:
    """Null distribution of the selected rules, in batches, until a batch's relative error is small; and its summary.

    ``save`` turns a batch's lazy table into a stored one; the default writes
    it to the shared folder.
    """
    rules = [r for r in selected_rules(mining_res) if all(f in df.columns for f, _ in r)]
    if not rules:
        raise ValueError("no selected rules")
    keep = save or (lambda t: saved(t, "null"))
    done, out = 0, None
    while done < n_null:
        ks = range(done, min(n_null, done + es_m_permutations))
        batch = keep(null_stats(df, rules, target_col, ks, random_state))
        out = batch if out is None else out.unionByName(batch)
        done = ks[-1] + 1
        error = compute_relative_error(out, early_stop_metric, "permutation", es_m_permutations)
        if error is not None and error < rel_error_threshold:
            break
    return out, summarize_null_distribution(out, early_stop_metric, "permutation")


def compute_empirical_pvals(actual_stats: DataFrame, null_stats: DataFrame, metric_col: str = "lift", mode: str = "greater", center: float | None = None, out_col: str = "pval") -> DataFrame:
    """Adds the share of pooled null values as large (small, far from the center) as the actual one.

    Both are put in order together and counted cumulatively; no value is
    compared with each other value.
    """
    mode = mode.replace("_", "-")
    if mode not in ("greater", "less", "two-sided"):
        raise ValueError(f"unknown mode {mode!r}")
    x, y = quoted(metric_col).cast("double"), quoted(metric_col).cast("double")
    if mode == "two-sided":
        if center is None:
            center = null_stats.agg(F.median(y)).first()[0] or 0.0
        x, y = F.abs(x - center), F.abs(y - center)
    sign = -1 if mode != "less" else 1
    levels = null_stats.filter(quoted(metric_col).isNotNull()).groupBy((y * sign).alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    wanted = actual_stats.select((x * sign).alias("_x")).filter("_x IS NOT NULL").distinct().select("_x", F.lit(0).cast("bigint").alias("_k"))
    merged = levels.unionByName(wanted).groupBy("_x").agg(F.sum("_k").alias("_k"))
    total = merged.agg(F.sum("_k").alias("_n"))  # one row
    at_most = global_cumulative(merged, "_x", "_k", "_below").crossJoin(F.broadcast(total))
    shares = at_most.select(F.col("_x").alias("_v"), F.when(F.col("_n") > 0, F.col("_below") / F.nullif(F.col("_n"), F.lit(0))).alias(out_col))
    return actual_stats.join(shares, (x * sign) == F.col("_v"), "left").drop("_v")


def global_cumulative(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the cumulative sum of a column over the whole table in order, ranges first, then inside them; ties together."""
    placed = ranged(df, [quoted(order).asc_nulls_last()], "cumulative").drop("_inside")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = placed.groupBy("_part").agg(F.sum(value).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(quoted(order).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_inside", inside).join(F.broadcast(shifts), "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: up to 100 summed, beyond by Euler and Maclaurin (to the precision of a double), so no task counts to n."""
    x = n.cast("double")
    summed = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(100)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return F.when(n > 100, F.ln(x) + F.lit(float(np.euler_gamma)) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)).otherwise(F.when(n > 0, summed))


def adjust_pvals(df: DataFrame, pval_col: str, method: str = "fdr_bh", out_col: str = "pval_adjusted") -> DataFrame:
    """Adds Benjamini-Hochberg (or -Yekutieli) adjusted p-values; nulls stay null.

    Rules are few compared with rows, and different p-values fewer still: the
    steps run over those.
    """
    if method not in ("fdr_bh", "fdr_by"):
        raise ValueError(f"unknown method {method!r}")
    p = quoted(pval_col)
    levels = df.filter(p.isNotNull()).groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    m = levels.agg(F.sum("_k").alias("_m"))
    ranked = global_cumulative(levels, "_p", "_k", "_rank").crossJoin(F.broadcast(m))  # one row
    factor = harmonic(F.col("_m")) if method == "fdr_by" else F.lit(1.0)
    raw = F.col("_p") * F.col("_m") * factor / F.col("_rank")
    lowest = F.min("_raw").over(Window.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0))
    steps = ranked.withColumn("_raw", raw).select(F.col("_p").alias("_v"), F.least(lowest, F.lit(1.0)).alias(out_col))
    return df.join(steps, p == F.col("_v"), "left").drop("_v")


def validate_multiple_tests(mining_res: DataFrame, null_df: DataFrame, early_stop_metric: str = "lift", mode: str = "greater", correction_alpha: float = 0.05, correction_metric: str = "fdr_bh", center: float | None = None) -> DataFrame:
    """Adds pval, pval_{correction} and {correction}_significant; what cannot be computed raises ValueError."""
    if early_stop_metric not in mining_res.columns or early_stop_metric not in null_df.columns:
        raise ValueError(f"no column {early_stop_metric!r}")
    with_p = compute_empirical_pvals(mining_res, null_df, early_stop_metric, mode, center)
    out = adjust_pvals(with_p, "pval", correction_metric, f"pval_{correction_metric}")
    return out.withColumn(f"{correction_metric}_significant", F.coalesce(F.col(f"pval_{correction_metric}") <= correction_alpha, F.lit(False)))


def summarize_fdr_results(df: DataFrame, pval_col: str = "pval", fdr_sig_col: str = "fdr_significant", correction_alpha: float = 0.05, groupby_col: str | None = None, as_markdown: bool = False):
    """Tests, significant ones before and after correction, and the p-values' least, median and largest; by group if asked."""
    p, s = quoted(pval_col), ensure_bool(quoted(fdr_sig_col))
    parts = [F.count(F.lit(1)).alias("n_tests"), F.count_if(p <= correction_alpha).alias("n_raw_significant"), F.count_if(s).alias("n_fdr_significant"), F.avg(s.cast("double")).alias("fdr_fraction"), F.min(p).alias("min_pval"), F.median(p).alias("median_pval"), F.max(p).alias("max_pval")]
    out = df.groupBy(quoted(groupby_col)).agg(*parts) if groupby_col else df.agg(*parts)
    if not as_markdown:
        return out
    rows = out.collect()
    lines = ["| " + " | ".join(out.columns) + " |", "|" + "---|" * len(out.columns)]
    return "\n".join([*lines, *["| " + " | ".join(str(v) for v in r) + " |" for r in rows]])
