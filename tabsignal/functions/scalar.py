"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value (compared after trimming and lower-casing, and as they are).
NULL_TOKENS = ["", " ", ".", "-", "nan", "n/a", "na", "null", "none", "None", "N/A", "NULL"]
#: Spellings of truth.
TRUE_TOKENS = ["true", "t", "yes", "y", "1"]
FALSE_TOKENS = ["false", "f", "no", "n", "0"]
#: Fixed value: stands for an infinite ratio.
INFINITE_RATIO = 1e60

#: Coefficients of Acklam's rational approximation of the normal quantile.
PROBIT_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PROBIT_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def squeezed(c: Column) -> Column:
    """Trimmed of white space, without line breaks and tabs, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""), r"[\n\r\t]", ""))


def blank_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def number(c: Column) -> Column:
    """The value as a double; what is no number, and NaN, is null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def clean_double(c: Column) -> Column:
    """A numeric column as double with NaN as null."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column, limit: float = INFINITE_RATIO) -> Column:
    """a / b with limit for what would be infinite; 0 / 0 is null."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when((b == 0) & (a > 0), F.lit(limit)).when((b == 0) & (a < 0), F.lit(-limit))


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, to about 1e-9."""
    low = 0.02425
    q = p - 0.5
    r = q * q
    middle = _horner(r, PROBIT_A) * q / (_horner(r, PROBIT_B) * r + 1.0)
    t = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _horner(t, PROBIT_C) / (_horner(t, PROBIT_D) * t + 1.0)
    return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < low, tail).when(p > 1 - low, -tail).otherwise(middle)


def bin_index(value: Column, edges: Column) -> Column:
    """0-based bin of right-closed bins with the lowest edge included; null outside."""
    above = F.size(F.filter(edges, lambda e: value > e))
    return F.when((value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1)), F.greatest(above - 1, F.lit(0)))
