"""A stored cube of scored trips: counts by carrier, origin, destination, day and value.

Kept by month, so that a new or corrected month is written alone. Every filter and every
summary of the analysis is answered from the counts; the records are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CARRIER, DATE, DEST, ORIGIN, PREDICTION
from .analysis import Filters, apply_filters, kpis, with_day

KEYS = (CARRIER, ORIGIN, DEST, DATE)
_MONTH = "cube_month"


def cube_of(scored: DataFrame) -> DataFrame:
    """One row for each carrier, origin, destination, day and value: how many trips have them.

    Trips without a value, or with one that is no number, are counted under NULL.
    """
    value = F.col(PREDICTION).cast("double")
    held = with_day(scored).select(*KEYS, F.when(~F.isnan(value), value).alias(PREDICTION))
    return held.groupBy(*KEYS, PREDICTION).agg(F.count("*").alias("rows"))


def store_cube(scored: DataFrame, folder: str) -> None:
    """Write or replace the months that ``scored`` has trips of; other months stay as they are."""
    month = F.coalesce(F.date_format(DATE, "yyyy-MM"), F.lit("none"))
    rows = cube_of(scored).withColumn(_MONTH, month)
    # Rows of a month meet; adaptive execution splits large months and joins small ones.
    even = rows.hint("rebalance", F.col(_MONTH))
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_MONTH).parquet(folder)


def read_cube(spark: SparkSession, folder: str, filters: Filters | None = None) -> DataFrame:
    """Counts of the trips that pass the filters; a date range reads its months alone."""
    cube = spark.read.parquet(folder)
    if filters and filters.date_range:
        first, last = (f"{d:%Y-%m}" for d in filters.date_range)
        cube = cube.where(F.col(_MONTH).between(first, last))
    return apply_filters(cube.drop(_MONTH), filters)


def cube_kpis(cube: DataFrame) -> DataFrame:
    """As ``analysis.kpis`` of the trips."""
    return kpis(cube, weight="rows")


def cube_sums(cube: DataFrame) -> DataFrame:
    """As ``analysis.group_sums`` of the trips, for all group tables."""
    total = F.sum(F.col(PREDICTION) * F.col("rows"))
    valued = F.sum(F.when(F.col(PREDICTION).isNotNull(), F.col("rows")).otherwise(0))
    return cube.groupBy(*KEYS).agg(total.alias("delay_sum"), valued.alias("delay_rows"))
