"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved

#: Parts into which the rows of a frequent key are dealt for a lookup.
SALTS = 64


def look_up(rows: DataFrame, key: str, table: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``table`` has for each ``key``, however frequent a key is in ``rows``.

    A key's rows are dealt over SALTS parts by a hash of the column ``spread``.
    Only the different (key, part) pairs, at most SALTS for a key, meet the
    table; they then meet the rows, part by part.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread), F.lit(17)), F.lit(SALTS)).cast("int"))
    found = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(found, [key, "_salt"], how).drop("_salt")


def _with_mins(edges: DataFrame) -> DataFrame:
    """Every edge and the least neighbour ``m`` of its ``u``."""
    return look_up(edges, "u", edges.groupBy("u").agg(F.min("v").alias("m")), "v")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """node, component of an edge table (u, v); a component is named by its least node.

    Loops and repeated edges do no harm; nodes without an edge do not appear.
    Each round joins every edge with the least neighbour of its ends, first
    for larger neighbours, then for smaller ones; the edges become stars in a
    number of rounds that grows with the logarithm of the longest path.  A
    round is written to the shared folder, so lineage stays short, and nothing
    but a count and a checksum comes to the driver.  The edges of a hub are
    spread over tasks (:func:`look_up`).
    """
    now = saved(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_mins(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_mins(large).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(mins.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_saved(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
