"""Dates and clock times from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import DATE_CASTS, DATE_FORMATS
from .numbers import hhmm_number


def parse_date(value: Column) -> Column:
    """Date of a text in any accepted shape, time of day dropped; NULL if invalid.

    The shape picks the one parser that runs, so a row never pays for failed
    parse attempts.
    """
    text = F.trim(value.cast("string"))
    parsed = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_FORMATS):
        parsed = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("date")).otherwise(parsed)
    for shape, kind in reversed(DATE_CASTS):
        parsed = F.when(text.rlike(shape), text.try_cast(kind).cast("date")).otherwise(parsed)
    return parsed


def as_date(value: Column, data_type: str) -> Column:
    """Date of a column that may be text, date or timestamp."""
    if data_type == "string":
        return parse_date(value)
    return value.cast("date")


def parse_hhmm(value: Column, data_type: str = "string") -> Column:
    """``'HH:mm'`` text of an HHMM number such as ``630`` or ``'0630'``; NULL if invalid."""
    clock = hhmm_number(value, data_type)
    clock = F.when(clock.between(0, 2359), clock)
    digits = F.lpad(clock.cast("string"), 4, "0")
    return F.when(
        clock % 100 < 60,
        F.concat(digits.substr(1, 2), F.lit(":"), digits.substr(3, 2)),
    )
