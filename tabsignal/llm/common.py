"""Helpers shared by the operators: column picking, shared folders, batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_saved, saved, scratch, shared_folder

__all__ = ["crc_of_id", "drop_saved", "in_slices", "pick", "positions", "saved", "scratch", "shared_folder", "slices", "text_batches"]

#: Rows in an Arrow batch of long texts; bounds what a Python worker holds.
TEXT_BATCH_ROWS = 256
#: Code points that a Python worker works on at a time.
SLICE_CHARS = 2_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name, the first of several alike.

    Spark resolves names without regard to case, so a table with ``text`` and
    ``Text`` has no unambiguous ``text``; picking by position avoids that.  A
    name the table lacks raises ValueError.
    """
    columns = df.columns
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {columns}")
    flat = df.toDF(*[f"_p{i}" for i in range(len(columns))])
    return flat.select(*[F.col(f"_p{columns.index(n)}").alias(n) for n in names])


def positions(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table under positional column names, and its own names in order."""
    return df.toDF(*[f"_p{i}" for i in range(len(df.columns))]), df.columns


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batch, text_index: int, chars: int = SLICE_CHARS) -> Iterator:
    """Cut an Arrow record batch into runs of rows of about ``chars`` text bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def in_slices(batches: Iterable, text_index: int, chars: int = SLICE_CHARS) -> Iterator:
    for batch in batches:
        if batch.num_rows:
            yield from slices(batch, text_index, chars)
