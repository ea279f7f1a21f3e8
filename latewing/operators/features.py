"""Model features of a trip: one projection, no shuffle, batch or stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import as_date
from ..functions.numbers import hhmm_number, number
from ..schema import MODEL_FEATURES, NUMERIC_FEATURES, InputError, require_columns


def _hour(hhmm: Column) -> Column:
    # Floor division, so that negative clock values round down.
    return F.floor(hhmm / 100).cast("int")


def _minute(hhmm: Column) -> Column:
    return F.pmod(hhmm, F.lit(100)).cast("int")


def _on_circle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / period
    return F.sin(angle), F.cos(angle)


def _joined(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), F.concat_ws("_", left, right))


def calendar_features(date: Column) -> dict[str, Column]:
    weekday = F.weekday(date)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "day": F.dayofmonth(date),
        "day_of_week": weekday,
        "week_of_year": F.weekofyear(date),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def clock_features(prefix: str, hhmm: Column) -> dict[str, Column]:
    hour, minute = _hour(hhmm), _minute(hhmm)
    return {
        f"{prefix}_hour": hour,
        f"{prefix}_minute": minute,
        f"{prefix}_time_minutes": hour * 60 + minute,
    }


def cyclical_features(hour: Column, weekday: Column, month: Column) -> dict[str, Column]:
    features = {}
    for name, value, period in (
        ("departure_hour", hour, 24),
        ("day_of_week", weekday, 7),
        ("month", month, 12),
    ):
        features[f"{name}_sin"], features[f"{name}_cos"] = _on_circle(value, period)
    return features


def departure_period(hour: Column) -> Column:
    return (
        F.when((hour < 0) | (hour > 23), F.lit(None).cast("string"))
        .when(hour <= 6, "night")
        .when(hour <= 12, "morning")
        .when(hour <= 18, "afternoon")
        .when(hour <= 23, "evening")
    )


def scheduled_departure(date: Column, hhmm: Column) -> Column:
    midnight = date.cast("timestamp_ntz")
    return midnight + F.make_dt_interval(hours=_hour(hhmm), mins=_minute(hhmm))


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """Every derived column by name, built from the raw columns of ``df``."""
    types = dict(df.dtypes)
    date = as_date(F.col("FL_DATE"), types["FL_DATE"])
    departs = hhmm_number(F.col("CRS_DEP_TIME"), types["CRS_DEP_TIME"])
    arrives = hhmm_number(F.col("CRS_ARR_TIME"), types["CRS_ARR_TIME"])
    calendar = calendar_features(date)
    departure = clock_features("departure", departs)
    hour = departure["departure_hour"]
    return {
        "scheduled_departure": scheduled_departure(date, departs),
        **calendar,
        **departure,
        **clock_features("arrival", arrives),
        **cyclical_features(hour, calendar["day_of_week"], calendar["month"]),
        "route": _joined(F.col("ORIGIN"), F.col("DEST")),
        "carrier_origin": _joined(F.col("OP_UNIQUE_CARRIER"), F.col("ORIGIN")),
        "departure_period": departure_period(hour),
        "distance_log": F.log1p(number(F.col("DISTANCE"), types["DISTANCE"])),
        "is_peak_departure": (hour.between(7, 9) | hour.between(16, 19)).cast("int"),
    }


def with_features(df: DataFrame) -> DataFrame:
    """Raw trips plus every model feature.

    Does not reject rows; use the feature rules of ``operators.quality`` to find
    or split off the rows whose features cannot be built.
    """
    require_columns(df.columns)
    return df.withColumns(feature_columns(df))


def model_frame(df: DataFrame, expected=MODEL_FEATURES) -> DataFrame:
    """Only the columns a model expects, after a schema check."""
    absent = [c for c in expected if c not in df.columns]
    if absent:
        raise InputError("Missing model features: " + ", ".join(absent))
    return df.select(*expected)


def impute_zero(df: DataFrame, columns=NUMERIC_FEATURES) -> DataFrame:
    """Numeric NULLs become 0."""
    return df.fillna(0, subset=[c for c in columns if c in df.columns])
