"""Table profiles: shape, missing values, distinct values, duplicates, counts, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .distribution import distribution, scalar_row


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, type, nulls, distinct_values) for every column from one aggregate.

    ``exact=False`` counts distinct values approximately, without shuffling them.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counts = df.agg(
        *(F.count_if(F.col(c).isNull()).alias(f"null{i}") for i, c in enumerate(columns)),
        *(distinct(F.col(c)).alias(f"distinct{i}") for i, c in enumerate(columns)),
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("type"),
            F.col(f"null{i}").alias("nulls"),
            F.col(f"distinct{i}").alias("distinct_values"),
        )
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def table_shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, columns and rows that repeat an earlier one in full.

    Copies are counted before the shuffle, so many copies of one row cost one
    row per task.
    """
    columns = list(columns or df.columns)
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("__n"))
        .agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
            F.lit(len(columns)).alias("columns"),
            F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, rows), most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "value")
    )


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: rows, mean, sample deviation, minimum, quartiles, maximum."""
    number = F.col(value).cast("double")
    summary = distribution(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    deviation = df.where(~F.isnan(number)).agg(F.stddev_samp(number).alias("std"))
    return summary.withColumn("std", scalar_row(deviation)["std"]).select(
        "rows", "mean", "std", "minimum", "q25", "q50", "q75", "maximum"
    )


#: HLL sketches of 2^12 registers: a distinct count is off by 1.6 % (one standard error).
HLL_BITS, HLL_ERROR = 12, 0.016
_PROFILE = "column string, rows bigint, nulls bigint, minimum string, maximum string, sketch binary"


def partial_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One mergeable row for each column: rows, NULLs, ends as text and a sketch of the distinct values.

    One scan; a task sends one row, whatever the number of values.
    """
    columns = list(columns or df.columns)
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    counts = df.agg(
        F.count("*").alias("rows"),
        *(F.count(text[c]).alias(f"known{i}") for i, c in enumerate(columns)),
        *(F.min(f"`{c}`").cast("string").alias(f"min{i}") for i, c in enumerate(columns)),
        *(F.max(f"`{c}`").cast("string").alias(f"max{i}") for i, c in enumerate(columns)),
        *(F.hll_sketch_agg(text[c], HLL_BITS).alias(f"hll{i}") for i, c in enumerate(columns)),
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"known{i}")).alias("nulls"),
            F.col(f"min{i}").alias("minimum"), F.col(f"max{i}").alias("maximum"), F.col(f"hll{i}").alias("sketch"),
        )
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def store_profile(df: DataFrame, folder: str, month: str) -> None:
    """Keep the partial profile of one month's rows; the other months' are neither read nor written."""
    partial_profile(df).coalesce(1).write.mode("overwrite").parquet(f"{folder}/month={month}")


def merged_profile(spark: SparkSession, folder: str) -> DataFrame:
    """(column, rows, nulls, distinct_values) over all kept months, from their partial profiles alone."""
    kept = spark.read.schema(_PROFILE).parquet(folder)
    return kept.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
