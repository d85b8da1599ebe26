"""Splits by time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from .target import as_timestamp
from .types import chosen


def parse_date_ranges(date_ranges) -> list[tuple[datetime, datetime]]:
    """Pairs of dates to pairs of times; anything else raises ValueError."""
    if not isinstance(date_ranges, (list, tuple)):
        raise ValueError("date ranges must be a list")
    out = []
    for pair in date_ranges:
        if not isinstance(pair, (list, tuple)) or len(pair) != 2:
            raise ValueError(f"a date range must be a pair, not {pair!r}")
        low, high = (x if isinstance(x, datetime) else datetime.fromisoformat(str(x)) for x in pair)
        if low >= high:
            raise ValueError(f"a date range must rise: {pair!r}")
        out.append((low, high))
    return out


def _span(df: DataFrame, date_col: str) -> tuple[datetime, datetime]:
    chosen(df, [date_col])
    low, high = df.agg(F.min(as_timestamp(df, date_col)), F.max(as_timestamp(df, date_col))).first()
    if low is None:
        raise ValueError("the table has no dates")
    return low, high


def _cut(df: DataFrame, date_col: str, ranges: Sequence[tuple[datetime, datetime, bool]]) -> tuple[list[DataFrame], DataFrame]:
    """A table for each range (start, end, end included), and a log of their rows."""
    t = as_timestamp(df, date_col)
    parts, counts = [], []
    for i, (low, high, closed) in enumerate(ranges):
        inside = (t >= F.lit(low)) & ((t <= F.lit(high)) if closed else (t < F.lit(high)))
        parts.append(df.filter(inside))
        counts += [F.count_if(inside).alias(f"_n{i}"), F.min(F.when(inside, t)).alias(f"_a{i}"), F.max(F.when(inside, t)).alias(f"_b{i}")]
    entries = [F.struct(F.lit(i).alias("split"), F.lit(low).alias("start"), F.lit(high).alias("end"), F.col(f"_n{i}").alias("n_rows"), F.col(f"_a{i}").alias("first"), F.col(f"_b{i}").alias("last")) for i, (low, high, _) in enumerate(ranges)]
    return parts, df.agg(*counts).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def generate_time_splits(df: DataFrame, date_col: str, n_splits: int | None = None, date_ranges=None) -> tuple[list[DataFrame], DataFrame]:
    """Half-open date ranges in order of start, or n parts of equal time, the last closed."""
    if date_ranges is not None:
        return _cut(df, date_col, [(a, b, False) for a, b in sorted(parse_date_ranges(date_ranges))])
    if not n_splits or n_splits < 1:
        raise ValueError("n_splits must be positive")
    low, high = _span(df, date_col)
    step = (high - low) / n_splits
    edges = [low + step * i for i in range(n_splits)] + [high]
    return _cut(df, date_col, [(a, b, i == n_splits - 1) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def fraction_windows(n_splits: int | None = None, window_frac: float | None = None, step_frac: float | None = None, fractions: Sequence[float] | None = None, overlap: bool = False) -> list[tuple[float, float]]:
    """Windows as shares of the time span: explicit fractions, a window and a step, or n equal parts (overlap halves the step)."""
    if fractions:
        if any(f <= 0 for f in fractions) or sum(fractions) > 1 + 1e-9:
            raise ValueError("fractions must be positive and sum to at most 1")
        ends = [0.0]
        for f in fractions:
            ends.append(ends[-1] + f)
        return list(zip(ends, ends[1:]))
    if n_splits and not window_frac:
        if n_splits < 1:
            raise ValueError("n_splits must be positive")
        width = 1 / n_splits
        step = width / 2 if overlap else width
    elif window_frac:
        width, step = window_frac, step_frac or window_frac
        if not 0 < width <= 1 or step <= 0:
            raise ValueError("window and step must be positive shares")
    else:
        raise ValueError("fractions, n_splits or window_frac is needed")
    out, at = [], 0.0
    while at + width <= 1 + 1e-9:
        out.append((at, min(1.0, at + width)))
        at += step
    return out


def generate_fraction_splits(df: DataFrame, date_col: str, n_splits: int | None = None, window_frac: float | None = None, step_frac: float | None = None, fractions: Sequence[float] | None = None, overlap: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """Splits by shares of the time span, not of the rows; a window that ends with the span is closed."""
    windows = fraction_windows(n_splits, window_frac, step_frac, fractions, overlap)
    low, high = _span(df, date_col)
    span: timedelta = high - low
    ranges = [(low + span * a, high if b > 1 - 1e-9 else low + span * b) for a, b in windows]
    return _cut(df, date_col, [(a, b, b == high or i == len(ranges) - 1) for i, (a, b) in enumerate(ranges)])
