"""Dropping columns that say little, and profiling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clean_double, quoted
from .scale import winsorize_flexible
from .stats import CHUNK
from .types import chosen, numeric_columns


def column_variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, variance (population)."""
    row = df.agg(*[F.var_pop(clean_double(quoted(c))).alias(c) for c in cols])
    return row.unpivot([], [quoted(c) for c in cols], "column", "variance")


def drop_low_variance_columns(df: DataFrame, cols: Sequence[str] | str | None = None, variance_threshold: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Drop columns with less variance than the threshold; no numeric column raises ValueError."""
    names = chosen(df, "all" if cols is None else cols)
    if not names:
        raise ValueError("no numeric columns")
    log = column_variances(df, names).withColumn("dropped", F.coalesce(F.col("variance") < variance_threshold, F.lit(True)))
    gone = {r["column"] for r in log.collect() if r["dropped"]}
    return df.select(*[quoted(c) for c in df.columns if c not in gone]), log


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """first, second, correlation of each pair, over rows where both are there."""
    values = {c: clean_double(quoted(c)) for c in cols}
    both = lambda a, b: values[a].isNotNull() & values[b].isNotNull()
    pairs, out = list(combinations(cols, 2)), df.sparkSession.createDataFrame([], "first string, second string, correlation double")
    for at in range(0, len(pairs), CHUNK):
        part = pairs[at : at + CHUNK]
        row = df.agg(*[F.corr(F.when(both(a, b), values[a]), F.when(both(a, b), values[b])).alias(f"_{i}") for i, (a, b) in enumerate(part)])
        entries = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"_{i}").alias("correlation")) for i, (a, b) in enumerate(part)]))
        rows = row.select(entries.alias("e")).select("e.*")
        out = rows if at == 0 else out.unionByName(rows)
    return out


def drop_highly_correlated_columns(df: DataFrame, cols: Sequence[str] | str | None = None, correlation_threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Drop each column whose correlation with any earlier one is above the threshold in size."""
    names = chosen(df, "all" if cols is None else cols)
    if not names:
        raise ValueError("no numeric columns")
    if len(names) < 2:
        return df, df.sparkSession.createDataFrame([], "first string, second string, correlation double")
    log = correlations(df, names).filter(F.abs("correlation") > correlation_threshold)
    gone = {r["second"] for r in log.collect()}
    return df.select(*[quoted(c) for c in df.columns if c not in gone]), log


def handle_outliers_and_redundancy(
    df: DataFrame,
    to_winsorize: bool = True,
    to_drop_var: bool = True,
    to_drop_corr: bool = True,
    winsor_cols="all",
    winsor_grouping: str = "none",
    id_cols=None,
    date_col=None,
    winsor_dt_units: int = 60,
    winsor_lower_quantile: float = 0.01,
    winsor_upper_quantile: float = 0.99,
    variance_threshold: float = 1e-8,
    correlation_threshold: float = 0.95,
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Winsorize, drop low variance, drop high correlation; the columns are looked up anew before each step."""
    logs: dict[str, DataFrame] = {}
    keep = [*(id_cols or ()), *([date_col] if date_col else []), *exclude]
    names = lambda: numeric_columns(df, keep)
    if to_winsorize and names():
        wanted = names() if winsor_cols == "all" else [c for c in winsor_cols if c in df.columns]
        df, logs["winsorize"] = winsorize_flexible(df, wanted, winsor_grouping, id_cols, date_col, winsor_dt_units, winsor_lower_quantile, winsor_upper_quantile)
    if to_drop_var and names():
        df, logs["low_variance"] = drop_low_variance_columns(df, names(), variance_threshold)
    if to_drop_corr and len(names()) > 1:
        df, logs["high_correlation"] = drop_highly_correlated_columns(df, names(), correlation_threshold)
    return df, logs


def profile(df: DataFrame) -> DataFrame:
    """column, dtype, n_rows, n_missing, n_distinct, min, max, mean, std (texts for min and max), in one aggregate."""
    parts = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(df.schema.fields):
        c, num = quoted(f.name), isinstance(f.dataType, T.NumericType)
        parts += [F.count(c).alias(f"_c{i}"), F.count_distinct(c).alias(f"_d{i}")]
        parts += [(F.avg(c).cast("double") if num else F.lit(None).cast("double")).alias(f"_m{i}"), (F.stddev_samp(c) if num else F.lit(None).cast("double")).alias(f"_s{i}")]
        parts += [F.min(c).cast("string").alias(f"_l{i}"), F.max(c).cast("string").alias(f"_h{i}")]
    entry = lambda i, f: F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"_c{i}")).alias("n_missing"), F.col(f"_d{i}").alias("n_distinct"), F.col(f"_l{i}").alias("min"), F.col(f"_h{i}").alias("max"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"))
    return df.agg(*parts).select(F.explode(F.array(*[entry(i, f) for i, f in enumerate(df.schema.fields)])).alias("e")).select("e.*")


def generate_data_summary(df: DataFrame, include_numeric_summary: bool = True, include_categorical_summary: bool = True, include_missingness: bool = True, high_cardinality_threshold: int = 50) -> dict:
    """Shape, types, constant, unique and high-cardinality columns, missingness, and summaries as tables."""
    table = profile(df)
    rows = table.collect()
    n = rows[0]["n_rows"] if rows else df.count()
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out: dict = {
        "shape": (n, len(df.columns)),
        "dtypes": dict(df.dtypes),
        "constant_columns": [r["column"] for r in rows if r["n_distinct"] <= 1],
        "unique_columns": [r["column"] for r in rows if n and r["n_distinct"] == n],
        "high_cardinality": [r["column"] for r in rows if r["column"] in strings and r["n_distinct"] >= high_cardinality_threshold],
        "columns_by_type": {"numeric": numeric_columns(df), "categorical": strings, "datetime": [c for c, t in df.dtypes if t.startswith(("date", "timestamp"))], "boolean": [c for c, t in df.dtypes if t == "boolean"]},
    }
    if include_missingness:
        out["missingness"] = {r["column"]: (r["n_missing"] / n if n else 0.0) for r in rows}
    if include_numeric_summary:
        out["numeric_summary"] = table.filter(F.col("mean").isNotNull())
    if include_categorical_summary and strings:
        modes = df.agg(*[F.mode(quoted(c), True).alias(c) for c in strings]).first()
        counts = df.agg(*[F.count_if(quoted(c) == F.lit(modes[c])).alias(c) for c in strings]).first()
        out["categorical_summary"] = {c: {"mode": modes[c], "freq": counts[c]} for c in strings}
    return out
