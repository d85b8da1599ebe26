"""Groups that many operators share: all rows, ids, blocks of rows in date order, both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from ..sources.shared import saved

GROUPINGS = ("none", "ids", "datetime", "datetime+ids")


def ranged(df: DataFrame, order: Sequence[Column], what: str) -> DataFrame:
    """The rows in order over the cluster, with ``_part`` (range) and ``_inside`` (0-based place in it).

    Ranges are cut by all of ``order``, so neither a frequent first value nor a
    text column lands in one task; the table is written to the shared folder,
    so that both of its readers see the same numbers.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return saved(placed, what).withColumn("_part", F.shiftright("_at", 33)).withColumn("_inside", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def global_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds a 0-based row number over the whole table without sorting it in one task.

    Ranges of all order columns are sorted each on its own and shifted by the
    counts of the ranges before.  Ties follow the remaining columns, nulls come
    last; rows that are equal throughout are spread over ranges as well.
    """
    sortable = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    keys = [quoted(c).asc_nulls_last() for c in [*order, *[c for c in sortable if c not in order]]]
    placed = ranged(df.withColumn("_tie", F.monotonically_increasing_id()), [*keys, F.col("_tie").asc()], "row-numbers").drop("_tie")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_inside") + F.col("_shift")).drop("_part", "_inside", "_shift")


def with_group(df: DataFrame, grouping: str, ids: Sequence[str] = (), date: str | None = None, units: int | None = None, name: str = "_group") -> DataFrame:
    """Adds the group label.  Blocks are of ``units`` rows in date order, ties by the ids and then all columns."""
    if grouping not in GROUPINGS:
        raise ValueError(f"grouping must be one of {GROUPINGS}, not {grouping!r}")
    label = F.concat_ws("_", *[quoted(c).cast("string") for c in ids]) if ids else None
    if grouping == "none":
        return df.withColumn(name, F.lit("all"))
    if grouping == "ids":
        if label is None:
            raise ValueError("id columns are needed")
        return df.withColumn(name, label)
    if not date or not units or units < 1:
        raise ValueError("a date column and a positive number of rows are needed")
    rest = [c for c in df.columns if c not in {date, *ids} and not dict(df.dtypes)[c].startswith("map")]
    if grouping == "datetime":
        numbered = global_row_number(df, [date, *ids, *rest], "_row")
        return numbered.withColumn(name, F.floor(F.col("_row") / units).cast("string")).drop("_row")
    if label is None:
        raise ValueError("id columns are needed")
    order = [quoted(c).asc_nulls_last() for c in (date, *rest)]
    row = F.row_number().over(Window.partitionBy(*[quoted(c) for c in ids]).orderBy(*order)) - 1
    return df.withColumn(name, F.concat(label, F.lit("_window_"), F.floor(row / units).cast("string")))


#: Up to so many rows a quantile is an aggregate that holds a group's different values; beyond, they stay spread.
AGGREGATED_ROWS = 20_000_000


def group_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], group: str = "_group") -> DataFrame:
    """``group``, _q0, _q1, ...: for each column the array of its exact quantiles, linearly interpolated; null without values.

    For tables of more than AGGREGATED_ROWS rows no task holds a group: the
    different values are counted (map-side first), ordered over the cluster by
    group and value, and cumulated range by range; the values at the wanted
    ranks are picked out by their cumulative counts.
    """
    marks = F.array(*[F.lit(float(q)) for q in shares])
    if df.count() <= AGGREGATED_ROWS:
        return df.groupBy(group).agg(*[F.percentile(quoted(c).cast("double"), marks).alias(f"_q{i}") for i, c in enumerate(columns)])
    out = df.select(group).distinct()
    for i, c in enumerate(columns):
        found = _spread_quantiles(df.select(F.col(group).alias("_g"), quoted(c).cast("double").alias("_v")), shares).withColumnRenamed("_at", f"_q{i}")
        out = out.join(found, out[group].eqNullSafe(found["_g"]), "left").drop("_g")
    return out


def value_ranks(df: DataFrame) -> DataFrame:
    """_g, _v, _k, _upto of a table of _g and _v: each different value, its rows, and the rows up to it over all groups.

    Values are counted (map-side first), ordered over the cluster and cumulated range by range; the table is stored.
    """
    levels = df.filter("_v IS NOT NULL").groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_k"))
    placed = ranged(levels, [F.col("_g").asc_nulls_first(), F.col("_v").asc()], "levels")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = placed.groupBy("_part").agg(F.sum("_k").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_shift"))
    inside = F.sum("_k").over(Window.partitionBy("_part").orderBy("_inside").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return saved(placed.withColumn("_upto", inside).join(F.broadcast(shifts), "_part").select("_g", "_v", "_k", (F.col("_upto") + F.col("_shift")).alias("_upto")), "ranks")


def _spread_quantiles(df: DataFrame, shares: Sequence[float]) -> DataFrame:
    """_g, _at of a table of _g and _v."""
    ranked = value_ranks(df)
    groups = ranked.groupBy("_g").agg(F.min(F.col("_upto") - F.col("_k")).alias("_start"), F.sum("_k").alias("_n"))
    # a group's row goes to each of SPREAD parts of its values
    parts = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"))
    both = ranked.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(SPREAD)).cast("int")).withColumnRenamed("_g", "_h")
    both = both.join(parts, both["_h"].eqNullSafe(parts["_g"]) & (both["_part"] == parts["_part"]))
    picks = []
    for j, q in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(float(q))
        for k, rank in enumerate((F.floor(place), F.ceil(place))):
            here = (F.col("_start") + rank >= F.col("_upto") - F.col("_k")) & (F.col("_start") + rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{j}_{k}"))
    got = both.groupBy("_g").agg(F.max("_n").alias("_n"), *picks)
    rest = lambda q: (F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q)))
    return got.select("_g", F.array(*[F.col(f"_{j}_0") + (F.col(f"_{j}_1") - F.col(f"_{j}_0")) * rest(q) for j, q in enumerate(shares)]).alias("_at"))


#: Parts over which the values of a group are spread.
SPREAD = 32


def join_stats(df: DataFrame, stats: DataFrame, group: str = "_group") -> DataFrame:
    """Adds the columns of a table of one row for each group."""
    return df.join(stats.withColumnRenamed(group, "_of"), df[group].eqNullSafe(F.col("_of")), "left").drop("_of")


def group_stats(df: DataFrame, aggregates: Sequence[Column], group: str = "_group") -> DataFrame:
    """Adds aggregates of each row's group, by an aggregate and a join.

    Partial aggregation comes before the shuffle, so a large group does not
    meet in one task as it would in a window.
    """
    return join_stats(df, df.groupBy(group).agg(*aggregates), group)
