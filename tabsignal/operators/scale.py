"""Outliers and scaling by group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clean_double, divide, probit, quoted
from .grouping import group_quantiles, group_stats, join_stats, with_group
from .types import chosen, numeric_columns, replace_columns


def _grouped(df: DataFrame, cols: Sequence[str], grouping: str, id_cols, date_col, units) -> tuple[DataFrame, list[str]]:
    ids = list(id_cols or ())
    names = chosen(df, cols, [*ids, *([date_col] if date_col else [])])
    typed = replace_columns(df, {c: clean_double(quoted(c)) for c in names})
    return with_group(typed, grouping, ids, date_col, units), names


def _long(df: DataFrame, group_first: Sequence[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*group_first)).alias("e")).select("e.*")


def winsorize_flexible(df: DataFrame, cols="all", grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None, lower_quantile: float = 0.01, upper_quantile: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Clip to the group's quantiles (linear interpolation); with a log of changed cells."""
    if not 0 <= lower_quantile < upper_quantile <= 1:
        raise ValueError("quantiles must rise from 0 to 1")
    base, names = _grouped(df, cols, grouping, id_cols, date_col, n_datetime_units)
    stats = join_stats(base, group_quantiles(base, names, (lower_quantile, upper_quantile)))
    clipped = {c: F.when(quoted(c).isNotNull(), F.greatest(F.col(f"_q{i}")[0], F.least(F.col(f"_q{i}")[1], quoted(c)))) for i, c in enumerate(names)}
    out = stats.select(*[clipped[c].alias(c) if c in clipped else quoted(c) for c in df.columns])
    cells = [F.struct(F.col("_group").alias("group"), F.lit(c).alias("column"), quoted(c).alias("before"), clipped[c].alias("after")) for c in names]
    return out, _long(stats, cells).filter("before <> after")


def winsorize(values, lower: float = 0.01, upper: float = 0.99):
    """Clip a pandas series to its own quantiles; for :func:`custom_apply_flexible`."""
    return values.clip(values.quantile(lower), values.quantile(upper))


def zscore_flexible(df: DataFrame, cols="all", grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None) -> tuple[DataFrame, DataFrame]:
    """(x - mean) / population deviation; null where the deviation is 0."""
    base, names = _grouped(df, cols, grouping, id_cols, date_col, n_datetime_units)
    aggregates = [a for i, c in enumerate(names) for a in (F.avg(quoted(c)).alias(f"_m{i}"), F.stddev_pop(quoted(c)).alias(f"_s{i}"))]
    out = group_stats(base, aggregates).select(*[divide(quoted(c) - F.col(f"_m{names.index(c)}"), F.col(f"_s{names.index(c)}")).alias(c) if c in names else quoted(c) for c in df.columns])
    log = _long(base.groupBy("_group").agg(*aggregates), [F.struct(F.col("_group").alias("group"), F.lit(c).alias("column"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std")) for i, c in enumerate(names)])
    return out, log


def robust_scale_flexible(df: DataFrame, cols="all", grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None, quantile_range=(25, 75)) -> tuple[DataFrame, DataFrame]:
    """(x - median) / (upper - lower quantile); null for under two values or a range of 0."""
    low, high = quantile_range
    if not 0 <= low < high <= 100:
        raise ValueError("quantile_range must rise from 0 to 100")
    base, names = _grouped(df, cols, grouping, id_cols, date_col, n_datetime_units)
    sizes = base.groupBy(F.col("_group").alias("_sized")).agg(*[F.count(quoted(c)).alias(f"_n{i}") for i, c in enumerate(names)])
    table = group_quantiles(base, names, (low / 100, 0.5, high / 100))
    table = table.join(sizes, table["_group"].eqNullSafe(sizes["_sized"])).drop("_sized")

    def scaled(c: str) -> Column:
        q = F.col(f"_q{names.index(c)}")
        return F.when(F.col(f"_n{names.index(c)}") >= 2, divide(quoted(c) - q[1], q[2] - q[0]))

    out = join_stats(base, table).select(*[scaled(c).alias(c) if c in names else quoted(c) for c in df.columns])
    fields = lambda i, c: F.struct(F.col("_group").alias("group"), F.lit(c).alias("column"), F.col(f"_q{i}")[1].alias("median"), F.col(f"_q{i}")[0].alias("q_low"), F.col(f"_q{i}")[2].alias("q_high"), (F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]).alias("iqr"), F.col(f"_n{i}").alias("n_obs"))
    return out, _long(table, [fields(i, c) for i, c in enumerate(names)])


def quantile_rank_transform_flexible(df: DataFrame, cols="all", mode: str = "quantile_normal", grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None) -> tuple[DataFrame, DataFrame]:
    """Average rank mapped to 0..1, or to normal quantiles; nulls stay, groups under two values are null.

    Ranks come from counts of the different values of each group, so ties and
    repeated values are counted before anything is ordered.
    """
    if mode not in ("rank", "quantile_uniform", "quantile_normal"):
        raise ValueError(f"unknown mode {mode!r}")
    base, names = _grouped(df, cols, grouping, id_cols, date_col, n_datetime_units)
    out, log = base, None
    for i, c in enumerate(names):
        values = base.filter(quoted(c).isNotNull()).groupBy("_group", quoted(c).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        w = Window.partitionBy("_group")
        below = F.coalesce(F.sum("_k").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("_k").over(w)
        cdf = F.when(total >= 2, (below + (F.col("_k") - 1) / 2) / F.nullif(total - 1, F.lit(0)))
        ranks = values.select(F.col("_group").alias("_g"), "_v", cdf.alias(f"_r{i}"), total.alias("_total"))
        out = out.join(ranks.drop("_total"), (out["_group"] == ranks["_g"]) & (quoted(c) == ranks["_v"]), "left").drop("_g", "_v")
        part = ranks.groupBy(F.col("_g").alias("group")).agg(F.lit(c).alias("column"), F.max("_total").alias("n_obs"))
        log = part if log is None else log.unionByName(part)

    def value(c: str) -> Column:
        r = F.col(f"_r{names.index(c)}")
        return probit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), r))) if mode == "quantile_normal" else r

    out = out.select(*[F.when(quoted(c).isNotNull(), value(c)).alias(c) if c in names else quoted(c) for c in df.columns])
    return out, log


def unit_vector_scale_flexible(df: DataFrame, cols="all", grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None, norm_type: str = "l2") -> tuple[DataFrame, DataFrame]:
    """x / norm of the group's column; null where the norm is 0."""
    norms: dict[str, Callable[[Column], Column]] = {"l2": lambda x: F.sqrt(F.sum(x * x)), "l1": lambda x: F.sum(F.abs(x)), "max": lambda x: F.max(F.abs(x))}
    if norm_type not in norms:
        raise ValueError(f"unknown norm {norm_type!r}")
    base, names = _grouped(df, cols, grouping, id_cols, date_col, n_datetime_units)
    aggregates = [norms[norm_type](quoted(c)).alias(f"_n{i}") for i, c in enumerate(names)]
    out = group_stats(base, aggregates).select(*[divide(quoted(c), F.col(f"_n{names.index(c)}")).alias(c) if c in names else quoted(c) for c in df.columns])
    return out, _long(base.groupBy("_group").agg(*aggregates), [F.struct(F.col("_group").alias("group"), F.lit(c).alias("column"), F.col(f"_n{i}").alias("norm")) for i, c in enumerate(names)])


def custom_apply_flexible(df: DataFrame, cols, func: Callable, grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None, func_kwargs: dict | None = None) -> DataFrame:
    """A function of a pandas series, giving one as long, on each column of each group.

    A group is one call, so it must fit in a worker.  Errors of the function
    are raised as RuntimeError, a wrong length as ValueError.
    """
    base, names = _grouped(df, cols, grouping, id_cols, date_col, n_datetime_units)
    kwargs = dict(func_kwargs or {})
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in names else f.dataType) for f in base.schema.fields if f.name != "_group"])

    def run(frame):
        frame = frame.drop(columns="_group")
        for c in names:
            try:
                made = func(frame[c], **kwargs)
            except Exception as e:
                raise RuntimeError(f"the function failed on column {c}: {e}") from e
            if len(made) != len(frame):
                raise ValueError(f"the function gave {len(made)} values for {len(frame)}")
            frame[c] = made
        return frame

    return base.groupBy("_group").applyInPandas(run, schema)


def normalize_features(df: DataFrame, scaling_method: str = "zscore", scale_cols=None, grouping: str = "none", id_cols=None, date_col=None, n_datetime_units=None, quantile_range=(25, 75), mode: str = "quantile_normal", norm_type: str = "l2", exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One of the scalers on the columns chosen; ids, the date and excluded columns are never scaled by 'all'."""
    if scale_cols is None or scale_cols == "all":
        scale_cols = numeric_columns(df, [*(id_cols or ()), *([date_col] if date_col else []), *exclude])
    args = dict(cols=scale_cols, grouping=grouping, id_cols=id_cols, date_col=date_col, n_datetime_units=n_datetime_units)
    if scaling_method == "zscore":
        return zscore_flexible(df, **args)
    if scaling_method == "robust":
        return robust_scale_flexible(df, quantile_range=quantile_range, **args)
    if scaling_method == "quantile_rank":
        return quantile_rank_transform_flexible(df, mode=mode, **args)
    if scaling_method == "unit_vector":
        return unit_vector_scale_flexible(df, norm_type=norm_type, **args)
    raise ValueError(f"unknown scaling method {scaling_method!r}")
