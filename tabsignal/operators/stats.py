"""Contingency counts and rule metrics.

Counts of many conditions come from one aggregate by class: sums of the
conditions for each class give the first cell of every 2x2 table, and the other
cells follow by arithmetic, so rows are never multiplied by features.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, get_stat_registry
from ..functions.scalar import quoted
from .types import chosen

#: Conditions counted in one aggregate.
CHUNK = 300


def condition_counts(df: DataFrame, conditions: dict[str, Column], target_col: str) -> DataFrame:
    """antecedents, consequents, a, antecedent_total, target_total, total for every condition and class.

    Rows with a null target count as the class 'null'.
    """
    target = F.coalesce(quoted(target_col).cast("string"), F.lit("null")).alias("consequents")
    out = None
    names = list(conditions)
    for at in range(0, len(names), CHUNK):
        part = names[at : at + CHUNK]
        sums = df.groupBy(target).agg(F.count(F.lit(1)).alias("target_total"), *[F.count_if(conditions[n]).alias(f"_s{i}") for i, n in enumerate(part)])
        entries = F.explode(F.array(*[F.struct(F.lit(n).alias("antecedents"), F.col(f"_s{i}").alias("a")) for i, n in enumerate(part)])).alias("e")
        rows = sums.select("consequents", "target_total", entries).select("e.antecedents", "consequents", "e.a", "target_total")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return df.sparkSession.createDataFrame([], "antecedents string, consequents string, a long, antecedent_total long, target_total long, total long")
    each = Window.partitionBy("antecedents")  # a row for each class
    return out.select("antecedents", "consequents", "a", F.sum("a").over(each).alias("antecedent_total"), "target_total", F.sum("target_total").over(each).alias("total"))


def _binary(df: DataFrame, feature_cols: Sequence[str]) -> dict[str, Column]:
    """Features as conditions; a value other than 0, 1 and null raises ValueError."""
    texts = {c: quoted(c).cast("string") for c in feature_cols}
    good = ("0", "1", "0.0", "1.0", "true", "false")
    names = list(feature_cols)
    for at in range(0, len(names), CHUNK):
        part = names[at : at + CHUNK]
        row = df.agg(*[F.count_if(~texts[c].isin(*good)) for c in part]).first()
        bad = [c for c, n in zip(part, row) if n]
        if bad:
            raise ValueError(f"features are not binary: {bad}")
    return {c: F.coalesce(x.isin("1", "1.0", "true"), F.lit(False)) for c, x in texts.items()}


def binary_counts(df: DataFrame, feature_cols: Sequence[str], target_col: str) -> DataFrame:
    """feature, feature_value, target, count of binary features, cells of 0 left out."""
    counts = condition_counts(df, _binary(df, feature_cols), target_col)
    cells = F.explode(F.array(F.struct(F.lit(1).alias("v"), F.col("a").alias("n")), F.struct(F.lit(0).alias("v"), (F.col("target_total") - F.col("a")).alias("n")))).alias("e")
    return counts.select(F.col("antecedents").alias("feature"), F.col("consequents").alias("target"), cells).filter("e.n > 0").select("feature", F.col("e.v").alias("feature_value"), "target", F.col("e.n").alias("count"))


def with_metrics(counts: DataFrame, stat_registry: dict[str, Metric] | None = None) -> DataFrame:
    """antecedents, consequents and metrics from what :func:`condition_counts` gives."""
    registry = stat_registry or get_stat_registry()
    a, with_condition, n_class, n = (F.col(c).cast("double") for c in ("a", "antecedent_total", "target_total", "total"))
    cells = {"a": a, "b": with_condition - a, "c": n_class - a, "d": n - with_condition - n_class + a, "target_total": n_class, "total": n}
    return counts.select("antecedents", "consequents", *[f(cells).alias(k) for k, f in registry.items()])


def calculate_association_metrics(df: DataFrame, target_col: str = "return", stat_registry: dict[str, Metric] | None = None) -> DataFrame:
    """Metrics of ``feature == 1`` against each class, for all other columns, by falling support."""
    chosen(df, [target_col])
    features = [c for c in df.columns if c != target_col]
    conditions = {f"{c} == 1": x for c, x in _binary(df, features).items()}
    return with_metrics(condition_counts(df, conditions, target_col), stat_registry).orderBy(F.col("support").desc_nulls_last() if stat_registry is None or "support" in stat_registry else "antecedents", "antecedents", "consequents")


def _filter_column(kind: str, metric: str, limit) -> Column:
    x = quoted(metric).cast("double")
    if kind == "min":
        return x >= limit
    if kind == "max":
        return x <= limit
    low, high = limit
    return (x <= low) | (x >= high) if kind == "bounds" else (x >= low) & (x <= high)


def apply_statistic_filters(result_df: DataFrame, filter_config: dict) -> tuple[DataFrame, DataFrame]:
    """Adds ``selected``: all of stat_{min,max,bounds,range}_{metric} hold.

    bounds keeps what is outside, range what is inside, limits included; a
    missing value fails.  Also a one-row summary of the numeric columns.
    """
    keep = F.lit(True)
    for key, limit in filter_config.items():
        if limit is None:
            continue
        m = re.fullmatch(r"(?:stat_)?(min|max|bounds|range)_(.+)", key)
        if not m:
            raise ValueError(f"unknown filter {key!r}")
        if m[2] not in result_df.columns:
            raise ValueError(f"no column {m[2]!r} to filter")
        c = _filter_column(m[1], m[2], limit)
        keep = keep & F.coalesce(c & ~F.isnan(quoted(m[2]).cast("double")), F.lit(False))
    out = result_df.withColumn("selected", keep)
    numbers = [c for c, t in result_df.dtypes if t in ("double", "float", "int", "bigint")]
    summary = [F.count(F.lit(1)).alias("n_rules"), F.count_if("selected").alias("n_selected")]
    summary += [f(quoted(c)).cast("double").alias(f"{c}_{k}") for c in numbers for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return out, out.agg(*summary)


def extract_stat_filter_config(cfg) -> dict:
    """All stat_ settings of a configuration; none raises ValueError."""
    values = cfg if isinstance(cfg, dict) else vars(cfg)
    found = {k: v for k, v in values.items() if k.startswith("stat_")}
    if not found:
        raise ValueError("the configuration has no stat_ filters")
    return found


def build_filter_config(cfg, overrides: dict | None = None) -> dict:
    return extract_stat_filter_config(cfg) | (overrides or {})


def generate_statistics(df: DataFrame, cfg, overrides: dict | None = None, stat_registry: dict[str, Metric] | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics of all features that are no id, date or dropped column, with filters applied."""
    get = cfg.get if isinstance(cfg, dict) else lambda k, d=None: getattr(cfg, k, d)
    target = get("target_col")
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    gone = {*(get("id_cols") or ()), get("date_col"), *(get("drop_cols") or ())} - {target}
    features = df.select(*[quoted(c) for c in df.columns if c not in gone])
    return apply_statistic_filters(calculate_association_metrics(features, target, stat_registry), build_filter_config(cfg, overrides))
