"""Number parsing and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_MAX_DOUBLE = 1.7976931348623157e308
_MAX_HHMM = 1_000_000_000
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are computed once per row.

    A plain projection is copied into every filter and expression built on it;
    the one-element array keeps Spark from doing so, which matters for parsing.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def decimal_number(text: Column) -> Column:
    """Decimal text as a double, else NULL; text that only the JVM calls a number, such as ``1d``, is none.

    Whole numbers, which begin and end with a digit, are cast without a look at their shape.
    """
    last = F.substring(text, -1, 1)
    whole = F.when((text >= "0") & (text < ":") & (last >= "0") & (last < ":"), text.try_cast("bigint"))
    return F.coalesce(whole.cast("double"), F.regexp_extract(text, _DECIMAL_TEXT, 0).try_cast("double"))


def number(value: Column, data_type: str = "string") -> Column:
    return decimal_number(value) if data_type == "string" else value.cast("double")


def is_finite(value: Column) -> Column:
    """False for NULL, NaN (which sorts above every number in Spark) and infinities."""
    return F.coalesce(F.abs(value) <= _MAX_DOUBLE, F.lit(False))


def is_hhmm(value: Column) -> Column:
    """True for a whole number within reach."""
    return F.coalesce((value % 1 == 0) & (F.abs(value) <= _MAX_HHMM), F.lit(False))


def finite_number(value: Column, data_type: str = "string") -> Column:
    """Text or number as a finite double; anything else is NULL."""
    parsed = number(value, data_type)
    return F.when(is_finite(parsed), parsed)


def hhmm_number(value: Column, data_type: str = "string") -> Column:
    """HHMM as a whole number; NULL when not whole or out of reach."""
    if data_type in _INTEGRAL:
        return F.when(F.abs(value.cast("bigint")) <= _MAX_HHMM, value.cast("bigint"))
    parsed = number(value, data_type)
    return F.when(is_hhmm(parsed), parsed.cast("bigint"))


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Scale, round half to even, scale back: the array-library rule."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
