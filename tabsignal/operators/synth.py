"""Synthetic rows, class imbalance, random flips, unions.

Random draws come from hashes of a row's content, its number among equal rows,
and a seed, so they depend neither on partitions nor on files nor on retries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_double, probit, quoted
from ..sources.shared import drop_saved
from .grouping import value_ranks
from .prune import correlations
from .types import chosen, numeric_columns


def uniform(key: Column, *seed) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(key, *[F.lit(s) for s in seed]), F.lit(1 << 53)) / F.lit(float(1 << 53))


def keyed(df: DataFrame) -> DataFrame:
    """The rows with ``_key``, a hash of the content and of the number among equal rows; the order is not kept.

    Equal rows are counted (map-side first) and written out again, COPIES in a
    task's row, so a row that makes up a third of the table is spread.
    """
    maps = {c for c, t in df.dtypes if t.startswith("map")}
    flat = df.select(*[F.array_sort(F.map_entries(quoted(c))).alias(f"_c{i}") if c in maps else quoted(c).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    names = flat.columns
    blocks = flat.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select("*", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")).alias("_b"))
    spread = blocks.repartition(F.xxhash64(*names, "_b"))
    rows = spread.select("*", F.explode(F.expr(f"sequence(1, cast(least({COPIES}, _n - _b * {COPIES}) as int))")).alias("_i"))
    back = [F.map_from_entries(f"_c{i}").alias(c) if c in maps else F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)]
    return rows.select(*back, F.xxhash64(*names, F.col("_b"), F.col("_i")).alias("_key"))


def normal_share(x: Column) -> Column:
    """Distribution function of the standard normal, to about 1e-7 (a rational approximation of the tail)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    tail = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


#: Quantiles of a number column run from 0 to 1 in so many steps.
STEPS = 1000


def _marks(ranked: DataFrame, n: int) -> list[float]:
    """The STEPS + 1 quantiles (linear interpolation) of n values, from their counts and cumulative counts.

    A different value knows by its ranks which quantiles lie on it or begin at it; no task holds the values.
    """
    at = lambda rank: F.floor(rank * F.lit(STEPS / max(1, n - 1)))
    # the steps whose place may be next to the ranks from _upto - _k to _upto - 1; the exact test follows
    near = F.explode(F.sequence(F.greatest(at(F.col("_upto") - F.col("_k") - 1) - 1, F.lit(0)), F.least(at(F.col("_upto")) + 1, F.lit(STEPS))))
    place = (F.col("_j") / F.lit(float(STEPS))) * F.lit(float(n - 1))
    here = lambda rank: (rank >= F.col("_upto") - F.col("_k")) & (rank < F.col("_upto"))
    found = ranked.select("_v", "_k", "_upto", near.alias("_j")).filter(here(F.floor(place)) | here(F.ceil(place)))
    picked = found.groupBy("_j").agg(F.max(F.when(here(F.floor(place)), F.col("_v"))).alias("low"), F.max(F.when(here(F.ceil(place)), F.col("_v"))).alias("high"), F.first(place - F.floor(place)).alias("rest"))
    return [r[0] for r in picked.orderBy("_j").select(F.col("low") + (F.col("high") - F.col("low")) * F.col("rest")).collect()]


def generate_synthetic_data_copula(df: DataFrame, num_rows: int, seed: int = 42) -> DataFrame:
    """Rows of a Gaussian copula: normal scores' correlation and each column's own distribution.

    Numbers follow the column's quantiles.  Texts and booleans follow their
    shares: a value stands for a part of the unit interval as wide as its
    share, and its middle gives the normal score.  A null raises ValueError, as
    do columns of other types and more than CATEGORIES texts.  The correlation
    matrix, 1001 quantiles of a column, and the shares come to the driver.
    """
    return _copula(df, num_rows, seed)[0]


def _copula(df: DataFrame, num_rows: int, seed: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """The synthetic rows, and the quantiles of each number column of the table.

    A number column's different values are counted and ranked once, over the
    cluster; normal scores and quantiles both come from those ranks.
    """
    numbers = set(numeric_columns(df))
    texts = [c for c, t in df.dtypes if t in ("string", "boolean")]
    other = [c for c in df.columns if c not in numbers and c not in texts]
    if not df.columns or other:
        raise ValueError(f"columns that are neither numbers nor texts nor booleans: {other}")
    if any(df.agg(*[F.count_if(quoted(c).isNull()) for c in df.columns]).first()):
        raise ValueError("the table has nulls")
    names = list(df.columns)
    flat = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    n = flat.count()
    if not n:
        raise ValueError("the table has no rows")
    shares: dict[int, list[tuple]] = {}
    for i, c in enumerate(names):
        if c in numbers:
            continue
        counts = sorted((tuple(r) for r in flat.groupBy(f"c{i}").count().limit(CATEGORIES + 1).collect()), key=lambda r: str(r[0]))
        if len(counts) > CATEGORIES:
            raise ValueError(f"column {c!r} has more than {CATEGORIES} different values")
        at, shares[i] = 0, []
        for value, k in counts:
            shares[i].append((value, at / n, (at + k) / n))
            at += k
    normal, marks, held = flat, {}, []
    for i, c in enumerate(names):
        if c not in numbers:
            continue
        ranked = value_ranks(flat.select(F.lit(0).alias("_g"), clean_double(F.col(f"c{i}")).alias("_v")))
        held.append(ranked)
        rows = ranked.agg(F.sum("_k")).first()[0] or 0
        marks[c] = _marks(ranked, rows)
        place = F.when(F.lit(rows >= 2), (F.col("_upto") - F.col("_k") + (F.col("_k") - 1) / 2) / F.lit(float(max(1, rows - 1))))
        scores = ranked.select(F.col("_v").alias(f"_v{i}"), probit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), place))).alias(f"_s{i}"))
        normal = normal.join(scores, clean_double(F.col(f"c{i}")) == F.col(f"_v{i}")).drop(f"c{i}", f"_v{i}").withColumnRenamed(f"_s{i}", f"c{i}")
    for i, parts in shares.items():
        middle = F.element_at(F.create_map(*[F.lit(x) for value, a, b in parts for x in (value, (a + b) / 2)]), F.col(f"c{i}"))
        normal = normal.withColumn(f"c{i}", probit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), middle))))
    matrix = np.zeros((len(names), len(names)))
    for r in correlations(normal, [f"c{i}" for i in range(len(names))]).collect():
        i, j = int(r["first"][1:]), int(r["second"][1:])
        matrix[i, j] = matrix[j, i] = r["correlation"] or 0.0
    for ranked in held:
        drop_saved(ranked)
    matrix = np.nan_to_num(matrix)
    np.fill_diagonal(matrix, 1.0)
    values, basis = np.linalg.eigh(matrix)
    root = basis * np.sqrt(np.maximum(values, 0))
    base = df.sparkSession.range(num_rows)
    # Box-Muller from hashed uniforms
    drawn = base.select("id", *[(F.sqrt(-2 * F.ln(1 - uniform(F.col("id"), seed, 2 * j))) * F.cos(2 * np.pi * uniform(F.col("id"), seed, 2 * j + 1))).alias(f"z{j}") for j in range(len(names))])
    mixed = drawn.select(*[sum((F.col(f"z{j}") * float(root[i, j]) for j in range(len(names))), F.lit(0.0)).alias(f"g{i}") for i in range(len(names))])
    out = []
    for i, c in enumerate(names):
        p = normal_share(F.col(f"g{i}"))
        if i in shares:
            table = F.array(*[F.struct(F.lit(value).alias("value"), F.lit(float(b)).alias("until")) for value, _, b in shares[i]])
            found = F.coalesce(F.filter(table, lambda e: p <= e["until"])[0]["value"], F.lit(shares[i][-1][0])) if shares[i] else F.lit(None)
            out.append(found.cast(df.schema[c].dataType).alias(c))
            continue
        at, table = p * STEPS, F.array(*[F.lit(float(q)) for q in marks[c]])
        k = F.floor(at).cast("int")
        low, high = F.get(table, k), F.get(table, F.least(k + 1, F.lit(STEPS)))
        out.append((low + (high - low) * (at - k)).cast(df.schema[c].dataType).alias(c))
    return mixed.select(*out), marks


def generate_synthetic_data(df: DataFrame, num_rows: int, model: str = "gaussian_copula", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows and a quality score of each column (1 less the largest gap of quantiles, relative to their span).

    Models other than the copula are deep generators, which need libraries that
    are not part of Spark: they raise NotImplementedError.
    """
    if model != "gaussian_copula":
        raise NotImplementedError(f"model {model!r} needs a deep-learning library; use 'gaussian_copula'")
    made, real = _copula(df, num_rows, seed)
    marks = F.array(*[F.lit(q / 20) for q in range(21)])
    names = numeric_columns(made)
    if not names:
        return made, df.sparkSession.createDataFrame([], "column string, quality double")
    a = {c: real[c][:: STEPS // 20] for c in names}
    b = made.agg(*[F.percentile(clean_double(quoted(c)), marks).alias(c) for c in names]).first()
    rows = [(c, float(1 - max(abs(x - y) for x, y in zip(a[c], b[c])) / ((a[c][-1] - a[c][0]) or 1.0))) for c in names]
    return made, df.sparkSession.createDataFrame(rows, "column string, quality double")


def generate_synthetic_data_synthcity(df: DataFrame, target_col: str, n_rows: int, model: str = "ctgan", **_) -> DataFrame:
    """Deep generators by plug-in name: none ships with this library."""
    raise NotImplementedError(f"model {model!r} needs a deep-learning library")


def generate_skewed_proportions(df: DataFrame, target_col: str, power: float = 1.5) -> DataFrame:
    """target, proportion: (1 / frequency) ** power, normalised."""
    counts = df.groupBy(quoted(target_col).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    raw = counts.crossJoin(F.broadcast(total)).select("target", F.pow(F.col("all") / F.col("n"), F.lit(float(power))).alias("w"))
    weights = raw.agg(F.sum("w").alias("sum"))  # one row
    return raw.crossJoin(F.broadcast(weights)).select("target", (F.col("w") / F.col("sum")).alias("proportion"))


#: Different values of a text column, at most.
CATEGORIES = 20_000
#: From this rate on the whole part is not drawn; copies of a row that are made at once.
POISSON_MOST, COPIES = 16, 10_000


def apply_class_imbalance(df: DataFrame, target_col: str, proportions: dict | None = None, random_state: int = 42) -> DataFrame:
    """Rows drawn with replacement so that classes come near the proportions (those of the skew if none are given).

    Each row is repeated a Poisson number of times, so the row count varies
    around the table's; from a rate of POISSON_MOST on, the whole part of the
    rate and a Poisson number of the rest.  There is no upper bound.
    """
    if proportions is None:
        proportions = {r["target"]: r["proportion"] for r in generate_skewed_proportions(df, target_col).collect()}
    if any(p < 0 for p in proportions.values()) or not sum(proportions.values()):
        raise ValueError("proportions must be positive")
    scale = sum(proportions.values())
    counts = {r[0]: r[1] for r in df.groupBy(quoted(target_col)).count().collect()}
    n = sum(counts.values())
    rates = {c: n * proportions.get(c, 0) / scale / k for c, k in counts.items() if c is not None}
    rate = F.coalesce(F.create_map(*[x for c, v in rates.items() for x in (F.lit(c), F.lit(float(v)))])[quoted(target_col)], F.lit(0.0)) if rates else F.lit(0.0)
    drawn = keyed(df)
    whole = F.when(rate < POISSON_MOST, F.lit(0)).otherwise(F.floor(rate)).cast("long")
    times = whole + poisson(uniform(F.col("_key"), random_state), rate - whole)
    names = [quoted(c) for c in df.columns]
    blocks = drawn.withColumn("_times", times).filter("_times > 0").select(*names, "_times", F.explode(F.expr(f"sequence(0L, (_times - 1) div {COPIES})")).alias("_b"))
    return blocks.select(*names, F.explode(F.expr(f"sequence(1, cast(least({COPIES}, _times - _b * {COPIES}) as int))")).alias("_r")).drop("_r")


def poisson(u: Column, rate: Column, most: int = 60) -> Column:
    """A Poisson number from a uniform one, by inversion; at most ``most``."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))
    step = lambda s, k: F.when(u > s["sum"], F.struct((s["term"] * rate / k).alias("term"), (s["sum"] + s["term"] * rate / k).alias("sum"), k.cast("int").alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["k"])


def fixed_poisson(u: Column, rate: float) -> Column:
    """A Poisson number of a rate known now: how many of its cumulative probabilities a uniform one is above."""
    term, total, steps = math.exp(-rate), math.exp(-rate), []
    while 1 - total > 1e-15 and len(steps) < 200:
        steps.append(total)
        term *= rate / len(steps)
        total += term
    return sum(((u > c).cast("int") for c in steps[1:]), (u > steps[0]).cast("int"))


def flip_boolean_values(df: DataFrame, columns: Sequence[str] | None = None, flip_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Flip each cell of boolean (or 0 and 1) columns with a probability."""
    if not 0 <= flip_fraction <= 1:
        raise ValueError("flip_fraction must be between 0 and 1")
    kinds = dict(df.dtypes)
    names = chosen(df, columns) if columns is not None else [c for c, t in df.dtypes if t == "boolean"]
    drawn = keyed(df)

    def flipped(i: int, c: str) -> Column:
        other = ~quoted(c) if kinds[c] == "boolean" else (1 - quoted(c)).cast(kinds[c])
        return F.when(uniform(F.col("_key"), seed, i) < flip_fraction, other).otherwise(quoted(c)).alias(c)

    return drawn.select(*[flipped(names.index(c), c) if c in names else quoted(c) for c in df.columns])


def flip_labels(df: DataFrame, target_col: str, flip_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """With a probability draw a label anew, which may be the old one."""
    if not 0 <= flip_fraction <= 1:
        raise ValueError("flip_fraction must be between 0 and 1")
    labels = sorted((r[0] for r in df.select(quoted(target_col)).na.drop().distinct().collect()), key=str)
    if not labels:
        return df
    pick = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.floor(uniform(F.col("_key"), seed, 1) * len(labels)) + 1).cast("int")).cast(df.schema[target_col].dataType)
    return keyed(df).select(*[F.when(uniform(F.col("_key"), seed) < flip_fraction, pick).otherwise(quoted(c)).alias(c) if c == target_col else quoted(c) for c in df.columns])


def generate_combined_synthetic_data(df: DataFrame, target_col: str | None = None, to_sdv: bool = True, to_synthcity: bool = False, sdv_model: str = "gaussian_copula", sdv_rows: int = 1000, sc_model: str = "ctgan", sc_rows: int = 1000, seed: int = 42) -> DataFrame:
    """The rows of all generators asked for; none raises ValueError.  The deep ones are not part of this library."""
    parts = []
    if to_sdv:
        parts.append(generate_synthetic_data(df, sdv_rows, sdv_model, seed)[0])
    if to_synthcity:
        parts.append(generate_synthetic_data_synthcity(df, target_col, sc_rows, sc_model))
    if not parts:
        raise ValueError("no generator was asked for")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def augment_dataset(df: DataFrame, target_col: str, to_aug_imbalance: bool = False, to_aug_flip_feats: bool = False, to_aug_flip_targets: bool = False, flip_feats_frac: float = 0.1, flip_targs_frac: float = 0.1, imbalance_proportions: dict | None = None, random_state: int = 42) -> DataFrame:
    """Imbalance, flips of features, flips of labels, each as asked."""
    if to_aug_imbalance:
        df = apply_class_imbalance(df, target_col, imbalance_proportions, random_state)
    if to_aug_flip_feats:
        df = flip_boolean_values(df, [c for c, t in df.dtypes if c != target_col and t in ("boolean", "tinyint")], flip_feats_frac, random_state)
    if to_aug_flip_targets:
        df = flip_labels(df, target_col, flip_targs_frac, random_state)
    return df


def coalesce_data(real_df: DataFrame | None, synth_df: DataFrame | None, augmented_real_df: DataFrame | None = None, augmented_synth_df: DataFrame | None = None) -> DataFrame:
    """Real and synthetic rows together, the augmented of each where there are such."""
    parts = [p for p in (augmented_real_df if augmented_real_df is not None else real_df, augmented_synth_df if augmented_synth_df is not None else synth_df) if p is not None]
    if not parts:
        raise ValueError("no rows are given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
