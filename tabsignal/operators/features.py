"""Feature engineering: ratios, lags, dates, bins, one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import INFINITE_RATIO, bin_index, clean_double, divide, quoted, ratio
from ..sources.shared import saved
from .grouping import group_quantiles, join_stats, with_group
from .types import chosen, numeric_columns, replace_columns

NO_DATA = "no_data"


def generate_ratio_features(df: DataFrame, columns="all", suffix: str = "ratio", max_replacement: float = INFINITE_RATIO) -> tuple[DataFrame, DataFrame]:
    """a / b of each pair of numeric columns; infinite ratios become +-max_replacement, 0 / 0 null."""
    names = [c for c in chosen(df, columns) if c in numeric_columns(df)]
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    made = [(a, b, f"{a}_div_{b}_{suffix}") for a, b in combinations(names, 2)]
    out = df.select(*[quoted(c) for c in df.columns], *[ratio(clean_double(quoted(a)), clean_double(quoted(b)), max_replacement).alias(n) for a, b, n in made])
    return out, df.sparkSession.createDataFrame(made, "numerator string, denominator string, feature string")


def _pct_change(c: str, n: int, ids: Sequence[str], date: str, infinite: bool = True) -> Column:
    """Change against n rows before; against 0 it is infinite (null if not ``infinite``), of 0 against 0 null."""
    w = Window.partitionBy(*[quoted(i) for i in ids]).orderBy(quoted(date).asc_nulls_last())
    x = clean_double(quoted(c))
    before = F.lag(x, n).over(w)
    if not infinite:
        return divide(x - before, before)
    against_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(before != 0, (x - before) / F.nullif(before, F.lit(0.0))).when(before == 0, against_zero)


def generate_temporal_pct_change(df: DataFrame, columns="all", id_cols: Sequence[str] = (), datetime_col: str = "", n_dt: int = 1, suffix: str = "pctchange", infinite: bool = True) -> tuple[DataFrame, DataFrame]:
    """(x - x n rows before) / that, by id in date order; against 0 infinite, or null as in SQL if not ``infinite``."""
    if n_dt < 1:
        raise ValueError("n_dt must be positive")
    chosen(df, [*id_cols, datetime_col])
    names = [c for c in chosen(df, columns, [*id_cols, datetime_col]) if c in numeric_columns(df)]
    out = df.select(*[quoted(c) for c in df.columns], *[_pct_change(c, n_dt, id_cols, datetime_col, infinite).alias(f"{c}_{suffix}") for c in names])
    return out, df.sparkSession.createDataFrame([(c, f"{c}_{suffix}", n_dt) for c in names], "column string, feature string, n_dt int")


def extract_date_features(df: DataFrame, date_col: str, prefix: str = "dt_") -> DataFrame:
    """Year, quarter, month, ISO week, weekday (Monday 0) as text; starts and ends of month, quarter, year as 0 or 1."""
    chosen(df, [date_col])
    d = quoted(date_col).cast("date")
    next_day = F.date_add(d, 1)
    flag = lambda unit, day: (F.trunc(day, unit) == day).cast("int")
    parts = {
        "year": F.year(d).cast("string"),
        "quarter": F.quarter(d).cast("string"),
        "month": F.month(d).cast("string"),
        "week": F.weekofyear(d).cast("string"),
        "weekday": F.weekday(d).cast("string"),
        **{f"is_{unit}_start": flag(unit, d) for unit in ("month", "quarter", "year")},
        **{f"is_{unit}_end": flag(unit, next_day) for unit in ("month", "quarter", "year")},
    }
    return df.select(*[quoted(c) for c in df.columns], *[v.alias(prefix + k) for k, v in parts.items()])


def _label(index: Column, edges: Column, labels: Sequence[str] | None, missing: str) -> Column:
    """Bin label; without labels the interval, and the placeholder where there is no bin or labels do not fit."""
    bins = F.size(edges) - 1
    if labels:
        name = F.when(bins == len(labels), F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1))
    else:
        show = lambda k: F.format_number(F.element_at(edges, k), 3)
        name = F.concat(F.when(index == 0, F.lit("[")).otherwise(F.lit("(")), show(index + 1), F.lit(", "), show(index + 2), F.lit("]"))
    return F.when((bins >= 1) & index.isNotNull(), F.coalesce(name, F.lit(missing))).otherwise(F.lit(missing))


def bin_columns_flexible(df: DataFrame, columns="all", quantiles: Sequence[float] = (0, 0.25, 0.5, 0.75, 1.0), quantile_labels: Sequence[str] | None = None, id_cols: Sequence[str] | None = None, date_col: str | None = None, grouping: str = "none", n_datetime_units: int | None = None, nan_placeholder: str = NO_DATA) -> tuple[DataFrame, DataFrame]:
    """Numbers to quantile bins of their group, right-closed, the lowest edge included.

    Edges that coincide are one.  Without labels the interval is the name; an
    empty list counts as none.  What cannot be binned is the placeholder.
    """
    keep = {*(id_cols or ()), *([date_col] if date_col else [])}
    names = [c for c in chosen(df, columns, keep) if c in numeric_columns(df)]
    if columns == "all":
        names = [c for c in names if not c.startswith("dt_")]
    typed = replace_columns(df, {c: clean_double(quoted(c)) for c in names})
    base = with_group(typed, grouping, list(id_cols or ()), date_col, n_datetime_units)
    table = group_quantiles(base, names, [float(q) for q in quantiles])
    table = table.select("_group", *[F.array_distinct(f"_q{i}").alias(f"_e{i}") for i in range(len(names))])
    joined = join_stats(base, table)
    value = lambda c: _label(bin_index(quoted(c), F.col(f"_e{names.index(c)}")), F.col(f"_e{names.index(c)}"), quantile_labels, nan_placeholder)
    out = joined.select(*[value(c).alias(c) if c in names else quoted(c) for c in df.columns])
    entries = [F.struct(F.col("_group").alias("group"), F.lit(c).alias("column"), F.col(f"_e{i}").alias("edges")) for i, c in enumerate(names)]
    log = table.select(F.explode(F.array(*entries)).alias("e")).select("e.*") if names else df.sparkSession.createDataFrame([], "group string, column string, edges array<double>")
    return out, log


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, count of each different value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("e")).groupBy("e.column", "e.value").count()


def sweep_low_count_bins(df: DataFrame, columns="all", min_count: int | None = None, min_fraction: float | None = None, reserved_labels: Sequence[str] | None = None, sweep_label: str = "others") -> tuple[DataFrame, DataFrame]:
    """Values rarer than max(min_count, int(min_fraction * rows)) become ``sweep_label``, reserved ones aside.

    Rare values are joined in, so any number of them is fine.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = strings if columns == "all" else chosen(df, columns)
    least = max(min_count or 0, int((min_fraction or 0) * df.count()) if min_fraction else 0)
    if not names:
        return df, df.sparkSession.createDataFrame([], "column string, value string, count long")
    counts = saved(category_counts(df, names), "category-counts")  # each column reads them
    rare = counts.filter((F.col("count") < least) & F.col("value").isNotNull() & ~F.col("value").isin(list(reserved_labels or [""])))
    out = df
    for i, c in enumerate(names):
        mine = rare.filter(F.col("column") == c).select(F.col("value").alias(f"_r{i}"))
        out = out.join(mine, quoted(c) == F.col(f"_r{i}"), "left")
    swept = {c: F.when(F.col(f"_r{i}").isNotNull(), F.lit(sweep_label)).otherwise(quoted(c)) for i, c in enumerate(names)}
    return out.select(*[swept[c].alias(c) if c in swept else quoted(c) for c in df.columns]), rare


def items(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), no_data_label: str | None = NO_DATA) -> DataFrame:
    """The one-hot table in long form: keys and an array of ``column=value``; its schema does not depend on values."""
    each = [F.when(quoted(c).isNotNull() & (quoted(c) != F.lit(no_data_label)) if no_data_label else quoted(c).isNotNull(), F.concat(F.lit(f"{c}="), quoted(c).cast("string"))) for c in columns]
    return df.select(*[quoted(k) for k in keys], F.array_compact(F.array(*each)).alias("items"))


def one_hot_encode_features(df: DataFrame, id_cols: Sequence[str] = (), date_col: str | None = None, drop_cols: Sequence[str] = (), no_data_label: str = NO_DATA, drop_no_data_columns: bool = False, max_columns: int = 20_000) -> DataFrame:
    """A boolean column ``column=value`` for each value of each text column; others pass.

    A null sets none.  More than ``max_columns`` new columns raise ValueError:
    use :func:`items` there.
    """
    keep = {*id_cols, *drop_cols, *([date_col] if date_col else [])}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not texts:
        return df
    found = category_counts(df, texts).filter("value IS NOT NULL").select("column", "value").limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} values; use items()")
    made = sorted((r["column"], r["value"]) for r in found)
    new = [F.coalesce(quoted(c) == F.lit(v), F.lit(False)).alias(f"{c}={v}") for c, v in made if not (drop_no_data_columns and f"={no_data_label}" in f"{c}={v}")]
    return df.select(*[quoted(c) for c in df.columns if c not in texts], *new)


def trend_label(change: Column, flat_threshold: Sequence[float]) -> Column:
    """down up to the lower bound, flat up to the upper, up above; null, and minus infinity, are no_data."""
    low, high = flat_threshold
    return F.when(change.isNull() | (change == F.lit(float("-inf"))), NO_DATA).when(change <= low, "down").when(change <= high, "flat").otherwise("up")


def generate_and_encode_temporal_trends(df: DataFrame, n_dt_list: Sequence[int], columns="all", id_cols: Sequence[str] = (), datetime_col: str = "", flat_threshold: Sequence[float] = (-0.01, 0.01), return_mode: str = "combined_only", infinite: bool = True) -> DataFrame:
    """Trends over several lags, longest first, joined to one pattern ``{column}_combined_trend``.

    Against 0 a change is infinite, or missing if not ``infinite``.

    Modes: combined_only, encoded_and_combined (also each trend),
    raw_and_combined (also each change).
    """
    if return_mode not in ("combined_only", "encoded_and_combined", "raw_and_combined"):
        raise ValueError(f"unknown return mode {return_mode!r}")
    names = [c for c in chosen(df, columns, [*id_cols, datetime_col]) if c in numeric_columns(df)]
    lags = sorted(set(n_dt_list), reverse=True)
    changes = {(c, n): f"{c}_pctchange_{n}" for c in names for n in lags}
    raw = df.select(*[quoted(c) for c in df.columns], *[_pct_change(c, n, id_cols, datetime_col, infinite).alias(k) for (c, n), k in changes.items()])
    out = [quoted(c) for c in df.columns]
    for c in names:
        labels = [trend_label(quoted(changes[c, n]), flat_threshold) for n in lags]
        if return_mode == "raw_and_combined":
            out += [quoted(changes[c, n]) for n in lags]
        if return_mode == "encoded_and_combined":
            out += [x.alias(f"{c}_{n}_trend") for n, x in zip(lags, labels)]
        out.append(F.concat_ws("_", *labels).alias(f"{c}_combined_trend"))
    return raw.select(*out)


def engineer_features(df: DataFrame, date_col: str, id_cols: Sequence[str], engineer_cols="base", to_engineer_dates: bool = False, to_engineer_ratios: bool = True, to_engineer_lags: bool = True, lag_mode: str = "raw_only", n_dt_list: Sequence[int] = (1, 2, 4), flat_threshold: Sequence[float] = (-0.01, 0.01), exclude: Sequence[str] = (), infinite: bool = True) -> DataFrame:
    """Dates, ratios, lags, each as asked; 'base' keeps ratios and lags to the numbers of the table as given.

    Changes against 0 are infinite, or null if not ``infinite``.
    """
    keep = [*id_cols, date_col, *exclude]
    base = numeric_columns(df, keep)
    if to_engineer_dates:
        df = extract_date_features(df, date_col)
    if to_engineer_ratios and len(base) > 1:
        df, _ = generate_ratio_features(df, base)
    if to_engineer_lags and base:
        cols = base if engineer_cols == "base" else numeric_columns(df, keep)
        if lag_mode == "raw_only":
            df, _ = generate_temporal_pct_change(df, cols, id_cols, date_col, list(n_dt_list)[0], infinite=infinite)
        else:
            df = generate_and_encode_temporal_trends(df, n_dt_list, cols, id_cols, date_col, flat_threshold, lag_mode, infinite)
    return df


def drop_no_data_patterns(df: DataFrame, acceptable_no_data: int = 0) -> DataFrame:
    """Drop trend columns whose pattern has more than so many no_data tokens."""
    gone = [c for c in df.columns if "_trend=" in c and c.split("_trend=", 1)[1].count(NO_DATA) > acceptable_no_data]
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def encode_data(df: DataFrame, date_col: str, id_cols: Sequence[str], drop_cols: Sequence[str] = (), bin_cols="all", bin_quantiles: Sequence[float] = (0, 0.25, 0.5, 0.75, 1.0), bin_quantile_labels: Sequence[str] | None = None, bin_grouping: str = "none", bin_dt_units: int = 20, to_sweep: bool = False, to_drop_no_data: bool = False, min_bin_obs: int = 20, min_bin_fraction: float = 0.01, lag_num_missing: int = 0) -> DataFrame:
    """Bin numbers, sweep rare values, one-hot encode, drop incomplete trend patterns."""
    numbers = numeric_columns(df, [*id_cols, date_col, *drop_cols]) if bin_cols == "all" else list(bin_cols)
    numbers = [c for c in numbers if not c.startswith("dt_")]
    df, _ = bin_columns_flexible(df, numbers, bin_quantiles, bin_quantile_labels or None, id_cols, date_col, bin_grouping, bin_dt_units)
    df = saved(df, "binned")  # the steps below read it for their decisions; edges are found once
    if to_sweep:
        keep = {*id_cols, date_col, *drop_cols}
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
        df, _ = sweep_low_count_bins(df, texts, min_bin_obs, min_bin_fraction, [NO_DATA])
    df = one_hot_encode_features(df, id_cols, date_col, drop_cols, drop_no_data_columns=to_drop_no_data)
    return drop_no_data_patterns(df, lag_num_missing)


def validate_pipeline_input(df: DataFrame, id_cols: Sequence[str], date_col: str, drop_cols: Sequence[str] | None = None, target_col: str | None = None) -> dict:
    """Whether a table is ready for mining: keys there and unique, features binary and without nulls; in one aggregate."""
    missing = [c for c in [*id_cols, date_col] if c not in df.columns]
    features = [c for c in df.columns if c not in {*id_cols, date_col, *(drop_cols or ()), target_col}]
    keys = [quoted(c) for c in [*id_cols, date_col] if c not in missing]
    parts = [F.count(F.lit(1)).alias("n"), (F.count_distinct(F.struct(*keys)) if keys else F.lit(0)).alias("keys")]
    for i, c in enumerate(features):
        parts += [F.count_if(~F.coalesce(quoted(c).cast("string").isin("0", "1", "true", "false", "0.0", "1.0"), F.lit(True))).alias(f"_b{i}"), F.count_if(quoted(c).isNull()).alias(f"_n{i}")]
    row = df.agg(*parts).first()
    report = {
        "missing_columns": missing,
        "n_rows": row["n"],
        "unique_keys": not missing and row["keys"] == row["n"],
        "non_binary_features": [c for i, c in enumerate(features) if row[f"_b{i}"]],
        "features_with_nulls": [c for i, c in enumerate(features) if row[f"_n{i}"]],
    }
    report["ready"] = not missing and report["unique_keys"] and not report["non_binary_features"] and not report["features_with_nulls"]
    return report
