"""Missing values: dropping, imputing, masking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import quoted
from .grouping import group_quantiles
from .types import chosen, numeric_columns, replace_columns

LOG_ALIASES = {"success": ("fill_successful", "imputed_successful", "success"), "percent": ("percent_filled", "percent_imputed", "percent")}


def missing_fractions(df: DataFrame) -> DataFrame:
    """column, missing: share of nulls of each column."""
    row = df.agg(*[F.avg(quoted(c).isNull().cast("double")).alias(c) for c in df.columns]) if df.columns else df
    return row.unpivot([], [quoted(c) for c in df.columns], "column", "missing")


def drop_high_missingness(df: DataFrame, row_thresh: float = 0.9, col_thresh: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Drop rows and columns whose share of nulls in the table as given is above the thresholds."""
    for x in (row_thresh, col_thresh):
        if not 0 < x < 1:
            raise ValueError("thresholds must be between 0 and 1")
    shares = {r[0]: r[1] or 0.0 for r in missing_fractions(df).collect()}
    dropped = [c for c, x in shares.items() if x > col_thresh]
    nulls = reduce(lambda a, b: a + b, [quoted(c).isNull().cast("int") for c in df.columns], F.lit(0))
    bad = nulls / F.lit(float(max(1, len(df.columns)))) > row_thresh
    out = df.filter(~bad).select(*[quoted(c) for c in df.columns if c not in dropped])
    lost = df.agg(F.count_if(bad).cast("double").alias("missing")).select(F.lit("row").alias("kind"), F.lit(None).cast("string").alias("name"), "missing")
    columns = df.sparkSession.createDataFrame([("column", c, float(shares[c])) for c in dropped], "kind string, name string, missing double")
    return out, columns.unionByName(lost)


def _fill(df: DataFrame, ids: Sequence[str], fills: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls from a table of a value for each group; null keys are no group."""
    joined = df.join(fills, [df[c] == fills[f"_k{i}"] for i, c in enumerate(ids)], "left")
    return joined.select(*[F.coalesce(quoted(c), F.col(f"_v{cols.index(c)}")).alias(c) if c in cols else df[c] for c in df.columns])


def _log(df: DataFrame, ids: Sequence[str], fills: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*[quoted(c) for c in ids]).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(quoted(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    both = counts.join(fills, [counts[c] == fills[f"_k{i}"] for i, c in enumerate(ids)])
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n"), F.col(f"_v{i}").cast("string").alias("v")) for i, c in enumerate(cols)])).alias("e")
    rows = both.select(*[counts[c] for c in ids], "_n", entry).filter("e.n > 0")
    return rows.select(*ids, F.col("e.column").alias("column"), F.col("e.n").alias("count_filled"), (F.col("e.n") / F.col("_n")).alias("percent_filled"), F.col("e.v").alias("fill_value"), F.col("e.v").isNotNull().alias("fill_successful"))


def _with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that hold a null."""
    row = df.agg(*[F.count_if(quoted(c).isNull()) for c in cols]).first()
    return [c for c, n in zip(cols, row) if n]


def _nothing(df: DataFrame, ids: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """Fills of no group: the log of columns without nulls has no rows."""
    return df.limit(0).select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(ids)], *[F.lit(None).cast(k).alias(f"_v{i}") for i, k in enumerate(kinds.values())])


def impute_numeric_per_group(df: DataFrame, id_cols: Sequence[str], impute_cols: Sequence[str], impute_strategy: str = "median") -> tuple[DataFrame, DataFrame]:
    """Fill nulls by the group's median or mean; a group without values stays null.

    Fills are looked for only in columns that hold a null.
    """
    if impute_strategy not in ("median", "mean"):
        raise ValueError("impute_strategy must be 'median' or 'mean'")
    cols = [c for c in chosen(df, impute_cols) if c not in id_cols]
    if not cols:
        return df, df.sparkSession.createDataFrame([], "column string")
    keys = [quoted(c).alias(f"_k{i}") for i, c in enumerate(id_cols)]
    typed = replace_columns(df, {c: quoted(c).cast("double") for c in cols})
    open_ = _with_nulls(df, cols)
    if not open_:
        return typed, _log(typed.limit(0), id_cols, _nothing(typed, id_cols, dict.fromkeys(cols, "double")), cols)
    cols = open_
    if impute_strategy == "mean":
        fills = df.groupBy(*keys).agg(*[F.avg(quoted(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(cols)])
    else:
        table = group_quantiles(df.select(F.struct(*keys).alias("_group") if keys else F.lit(0).alias("_group"), *[quoted(c) for c in cols]), cols, [0.5])
        fills = table.select(*[F.col(f"_group._k{i}").alias(f"_k{i}") for i in range(len(keys))], *[F.col(f"_q{i}")[0].alias(f"_v{i}") for i in range(len(cols))])
    return _fill(typed, id_cols, fills, cols), _log(typed, id_cols, fills, cols)


def fill_categorical_per_group(df: DataFrame, id_cols: Sequence[str], categorical_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fill nulls by the group's mode, ties by the smallest value; columns without a null pass."""
    cols = [c for c in chosen(df, categorical_cols) if c not in id_cols]
    if not cols:
        return df, df.sparkSession.createDataFrame([], "column string")
    open_ = _with_nulls(df, cols)
    if not open_:
        return df, _log(df.limit(0), id_cols, _nothing(df, id_cols, {c: dict(df.dtypes)[c] for c in cols}), cols)
    cols = open_
    fills = df.groupBy(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(id_cols)]).agg(*[F.mode(quoted(c), True).alias(f"_v{i}") for i, c in enumerate(cols)])
    return _fill(df, id_cols, fills, cols), _log(df, id_cols, fills, cols)


def mask_high_imputation(df: DataFrame, log_dfs: Sequence[DataFrame], id_cols: Sequence[str], max_imputed: float = 0.5) -> DataFrame:
    """Null a whole group's column where a log says that more than max_imputed of it was filled."""
    bad = None
    for log in log_dfs:
        success = next((c for c in LOG_ALIASES["success"] if c in log.columns), None)
        percent = next((c for c in LOG_ALIASES["percent"] if c in log.columns), None)
        if success is None or percent is None:
            continue
        part = log.filter(F.col(success) & (F.col(percent) > max_imputed)).select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(id_cols)], F.col("column").alias("_column"))
        bad = part if bad is None else bad.unionByName(part)
    if bad is None:
        return df
    marks = bad.groupBy(*[f"_k{i}" for i in range(len(id_cols))]).agg(F.collect_set("_column").alias("_masked"))  # at most a name for each column
    joined = df.join(marks, [df[c] == marks[f"_k{i}"] for i, c in enumerate(id_cols)], "left")
    return joined.select(*[df[c] if c in id_cols else F.when(~F.coalesce(F.array_contains("_masked", c), F.lit(False)), df[c]).alias(c) for c in df.columns])


def handle_missing_data(
    df: DataFrame,
    row_thresh: float = 0.9,
    col_thresh: float = 0.9,
    run_drop_high_missingness: bool = True,
    run_impute_numeric: bool = True,
    run_impute_categorical: bool = True,
    run_mask_high_imputation: bool = True,
    id_cols: Sequence[str] | None = None,
    impute_strategy: str = "median",
    max_imputed: float = 0.5,
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Drop, impute numbers, impute categories, mask; ids and excluded columns are left alone."""
    logs: dict[str, DataFrame] = {}
    ids, keep = list(id_cols or ()), {*(id_cols or ()), *exclude}
    if run_drop_high_missingness:
        df, logs["drop_high_missingness"] = drop_high_missingness(df, row_thresh, col_thresh)
    if ids and run_impute_numeric:
        cols = numeric_columns(df, keep)
        if cols:
            df, logs["impute_numeric"] = impute_numeric_per_group(df, ids, cols, impute_strategy)
    if ids and run_impute_categorical:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
        if cols:
            df, logs["impute_categorical"] = fill_categorical_per_group(df, ids, cols)
    if ids and run_mask_high_imputation:
        made = [logs[k] for k in ("impute_numeric", "impute_categorical") if k in logs]
        if made:
            df = mask_high_imputation(df, made, ids, max_imputed)
    return df, logs
