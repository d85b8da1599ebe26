"""Type detection and coercion of whole columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import FALSE_TOKENS, NULL_TOKENS, TRUE_TOKENS, blank_to_null, clean_double, number, quoted, squeezed

#: Formats tried in this order; the first that reads a value wins.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "dd-MM-yyyy",
    "yyyyMMdd",
    "yyyyMMdd HH:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "dd-MMM-yyyy",
    "yyyy-MM",
)
#: Texts that begin like an ISO date and time are read as such first, with fractions of seconds and zones.
ISO_TIME = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?\s*(Z|z|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)?$"
NUMERIC = (T.NumericType,)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in set(exclude)]


def chosen(df: DataFrame, columns: str | Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """'all' stands for the numeric columns that are not excluded; a missing name raises ValueError."""
    if columns is None or isinstance(columns, str) and columns == "all":
        return numeric_columns(df, exclude)
    columns = [columns] if isinstance(columns, str) else list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return columns


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The table with some columns replaced, in one projection."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def clean_raw_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim, drop line breaks and tabs, lower-case; null-like texts become null.  Other types stay."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))}
    return replace_columns(df, {c: blank_to_null(squeezed(quoted(c))) for c in chosen(df, cols) if c in strings})


def _shape(form: str) -> str:
    """A regular expression that every text met by a date format matches; others need no parsing, whose failures are dear."""
    parts = {"yyyy": "[+-]?[0-9]{4,}", "MMMM": "[^0-9]+", "MMM": "[^0-9]+", "d": "[0-9]+", "'T'": "[Tt]"}
    tokens = re.findall(r"'T'|([A-Za-z])(\1*)|(.)", form)
    if any(a + b not in parts and a + b not in ("MM", "dd", "HH", "mm", "ss") for a, b, _ in tokens if a):
        return ""  # a pattern that is not known here: all texts are tried
    return "^" + "".join("[Tt]" if not a and not other else parts.get(a + b, "[0-9]{2}") if a else re.escape(other) for a, b, other in tokens) + "$"


def to_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The moment a text names (in UTC where it has no zone), by the ISO form and then by the formats; else null."""
    text = F.trim(c.cast("string"))
    iso = F.regexp_replace(F.regexp_replace(F.upper(text), ",", "."), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.when(text.rlike(ISO_TIME), F.try_to_timestamp(iso))
    shapes = [_shape(f) for f in formats]
    read = F.coalesce(iso, *[F.when(text.rlike(s), F.try_to_timestamp(text, F.lit(f))) if s else F.try_to_timestamp(text, F.lit(f)) for s, f in zip(shapes, formats)])
    return F.when(text.rlike("|".join([ISO_TIME, *shapes])), read) if all(shapes) else read


def parse_datetime_column(df: DataFrame, column: str, floor_to_day: bool = False, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text to timestamp (UTC); what no form reads is null.  Names of months are English."""
    chosen(df, [column])
    kind = df.schema[column].dataType
    parsed = quoted(column).cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else to_timestamp(quoted(column), formats)
    return replace_columns(df, {column: F.date_trunc("DAY", parsed) if floor_to_day else parsed})


def _number(df: DataFrame, c: str) -> Column:
    """:func:`number`, without a text in between for types that need none."""
    plain = isinstance(df.schema[c].dataType, (T.DoubleType, T.IntegralType))
    return clean_double(quoted(c)) if plain else number(quoted(c))


def coerce_numeric_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """To bigint if all values are whole and none is missing, else double; a column without any number stays."""
    cols = chosen(df, cols)
    if not cols:
        return df
    values = {c: _number(df, c) for c in cols}
    parts = [x for c, v in values.items() for x in (F.count(v), F.count_if((v == F.floor(v)) & (F.abs(v) < 2**53)))]
    row = df.agg(F.count(F.lit(1)), *parts).first()
    new = {}
    for i, (c, v) in enumerate(values.items()):
        found, whole = row[1 + 2 * i], row[2 + 2 * i]
        if found:
            new[c] = v.cast("bigint") if whole == row[0] else v
    return replace_columns(df, new)


def boolean(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(TRUE_TOKENS), True).when(text.isin(FALSE_TOKENS), False)


def coerce_boolean_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spellings of truth to boolean, others null; a column without any stays."""
    cols = chosen(df, cols)
    if not cols:
        return df
    row = df.agg(*[F.count(boolean(quoted(c))) for c in cols]).first()
    return replace_columns(df, {c: boolean(quoted(c)) for c, n in zip(cols, row) if n})


def coerce_categorical_columns(df: DataFrame, cols: Sequence[str], lowercase: bool = True, strip: bool = True, nan_category: bool = False) -> DataFrame:
    """To text, trimmed and lower-cased as asked; nulls stay null, or become 'nan' if ``nan_category``."""
    new = {}
    for c in chosen(df, cols):
        text = quoted(c).cast("string")
        text = F.trim(text) if strip else text
        text = F.lower(text) if lowercase else text
        new[c] = F.coalesce(text, F.lit("nan")) if nan_category else text
    return replace_columns(df, new)


def clean_datetime_columns(df: DataFrame, col_types: dict[str, Sequence[str]]) -> DataFrame:
    for c in col_types.get("datetime", ()):
        df = parse_datetime_column(df, c)
    return df


def detect_column_types(df: DataFrame, numeric_threshold: float = 0.8, datetime_threshold: float = 0.8, boolean_threshold: float = 0.8) -> dict[str, list[str]]:
    """Columns by detected type, in one aggregate or two.

    Of the values that are not null-like, the share that reads as number, date
    or truth decides, in this order; else, or without values, categorical.
    Dates are only read in columns that are not numeric, in the second.  Numbers and
    moments are not written as texts: what those would read as follows from the type.
    """
    temporal = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))}
    numbers = set(numeric_columns(df))
    is_null = [t.lower() for t in NULL_TOKENS]
    parts, real = [], {}
    for c in df.columns:
        if c in temporal:  # no number, no truth, no null-like text
            real[c] = quoted(c).isNotNull()
            parts += [F.count_if(real[c]), F.lit(0), F.lit(0)]
            continue
        real[c] = clean_double(quoted(c)).isNotNull() if c in numbers else quoted(c).isNotNull() & ~F.lower(F.trim(quoted(c).cast("string"))).isin(is_null)
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):  # written with a point, so never as 0 or 1
            truths = F.lit(0)
        else:
            truths = F.count_if(real[c] & (quoted(c).isin(0, 1) if isinstance(kind, T.IntegralType) else boolean(quoted(c)).isNotNull()))
        parts += [F.count_if(real[c]), F.count_if(real[c] if c in numbers else real[c] & number(quoted(c)).isNotNull()), truths]
    row = df.agg(*parts).first() if parts else []
    counts = {c: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, c in enumerate(df.columns)}
    dates = {c: counts[c][0] for c in temporal}
    open_ = [c for c in df.columns if c not in temporal and counts[c][0] and counts[c][1] / counts[c][0] < numeric_threshold]
    if open_:
        dates |= dict(zip(open_, df.agg(*[F.count_if(real[c] & to_timestamp(quoted(c)).isNotNull()) for c in open_]).first()))
    found: dict[str, list[str]] = {}
    limits = (("numeric", numeric_threshold), ("datetime", datetime_threshold), ("boolean", boolean_threshold))
    for name in df.columns:
        n, good = counts[name][0], (counts[name][1], dates.get(name, 0), counts[name][2])
        kind = next((k for (k, least), g in zip(limits, good) if n and g / n >= least), "categorical")
        found.setdefault(kind, []).append(name)
    return found


def lookup_detected_type(column_types: dict[str, list[str]], column: str) -> str:
    return next((k for k, names in column_types.items() if column in names), "undetected")


def apply_column_type_cleaning(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean strings, detect types, coerce by them; with a log of each column."""
    cleaned = clean_raw_strings(df, df.columns)
    found = detect_column_types(cleaned)
    out = coerce_numeric_columns(cleaned, found.get("numeric", []))
    out = clean_datetime_columns(out, found)
    out = coerce_boolean_columns(out, found.get("boolean", []))
    out = coerce_categorical_columns(out, found.get("categorical", []))
    before, after = dict(df.dtypes), dict(out.dtypes)
    rows = [(c, before[c], lookup_detected_type(found, c), after[c], before[c] != after[c]) for c in df.columns]
    return out, df.sparkSession.createDataFrame(rows, "column_name string, original_dtype string, detected_type string, final_dtype string, changed boolean")
