"""Trip records derived from the order tables of a data folder.

``trip_facts`` needs one table and no join; ``trips`` adds the two places. Every
lookup side is a plain scan of known file size, so Spark broadcasts the small
ones and sort-merges the large ones; orders and customers meet before the record
table does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FACT_COLUMNS = (
    "FL_DATE",
    "OP_UNIQUE_CARRIER",
    "CRS_DEP_TIME",
    "CRS_ARR_TIME",
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "CANCELLED",
    "DIVERTED",
    "ARR_DELAY",
    "predicted_arr_delay",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
)

# Order that makes every record distinct within one date.
RECORD_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "DISTANCE")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _facts() -> dict[str, Column]:
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    late = F.when(order % 23 == 0, 200).otherwise(0)
    delay = (part * 31 + order * 17 + line * 7) % 60 - 25 + part % 24 + 2 * (supplier % 10) + late
    return {
        "FL_DATE": F.col("l_shipdate"),
        "OP_UNIQUE_CARRIER": F.concat(F.lit("C"), (supplier % 10).cast("string")),
        "CRS_DEP_TIME": ((part % 24) * 100 + order % 60).cast("int"),
        "CRS_ARR_TIME": (((part + supplier) % 24) * 100 + (order + line) % 60).cast("int"),
        "CRS_ELAPSED_TIME": (part % 310 - 5).cast("double"),
        "DISTANCE": quantity * 50,
        "CANCELLED": F.when(order % 50 == 0, 1.0).otherwise(0.0),
        "DIVERTED": F.when(order % 97 == 0, 1.0).otherwise(0.0),
        "ARR_DELAY": F.when(
            ~((order % 50 == 0) | (order % 97 == 0) | (part % 211 == 0)), delay.cast("double")
        ),
        "predicted_arr_delay": quantity - 5 + supplier % 10 - (part % 24) * 0.5,
        "l_orderkey": order,
        "l_linenumber": line,
        "l_partkey": part,
        "l_suppkey": supplier,
    }


def trip_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Trips without places: a projection of the record table."""
    return table(spark, folder, "lineitem").select(*(c.alias(n) for n, c in _facts().items()))


#: A scan of less than this many bytes for each core may be one task: Parquet is cut between row groups only.
_BYTES_A_CORE, _WORTH_SPREADING = 128 << 20, 4 << 20


def _bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_by_size(df: DataFrame, least: int = 1) -> int:
    """Partitions of ``df`` that hold about 32 MiB of its files each."""
    return max(least, -(-_bytes(df) // (32 << 20)))


def spread(df: DataFrame, source: DataFrame, key: Sequence[str] = RECORD_KEY) -> DataFrame:
    """``df`` over all cores, where ``source``, from which it comes, is too small to be read by as many tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = _bytes(source)
    held = [c for c in key if c in df.columns]
    return df.repartition(cores, *held) if _WORTH_SPREADING < size < cores * _BYTES_A_CORE else df


def with_places(facts: DataFrame, folder: str) -> DataFrame:
    """Trips plus origin (supplier's nation) and destination (customer's nation).

    Filter the trips first: what they lose is neither shuffled nor joined.
    """
    spark = facts.sparkSession
    nation = table(spark, folder, "nation")
    origins = nation.select(F.col("n_nationkey").alias("origin_key"), F.col("n_name").alias("ORIGIN"))
    dests = nation.select(F.col("n_nationkey").alias("dest_key"), F.col("n_name").alias("DEST"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("origin_key"))
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("dest_key"))
    orders = (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "dest_key")
    )
    joined = (
        facts
        # No hint: Spark knows both sizes and may broadcast what a filter has made small.
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(origins, "origin_key")
        .join(dests, "dest_key")
        .select(*facts.columns, "ORIGIN", "DEST")
    )
    # Spark may have broadcast small records, and then reads the orders by few tasks.
    return spread(joined, facts)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    return with_places(trip_facts(spark, folder), folder)


def raw_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Trips without places, with the calendar columns of the raw monthly files (some wrong on purpose)."""
    date = F.col("FL_DATE")
    return trip_facts(spark, folder).withColumns(
        {
            "YEAR": F.when(F.col("l_orderkey") % 101 == 0, F.year(date) + 1).otherwise(F.year(date)),
            "QUARTER": F.quarter(date),
            "MONTH": F.when(F.col("l_orderkey") % 103 == 0, F.lit(0)).otherwise(F.month(date)),
        }
    )


def text_trips(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Trips as an all-text file would hold them, a known share of them damaged; columns ``also`` stay as they are."""
    order = F.col("l_orderkey")
    day = F.when(order % 7 == 0, F.date_format("FL_DATE", "M/d/yyyy hh:mm:ss a")).otherwise(
        F.date_format("FL_DATE", "yyyy-MM-dd")
    )

    def clock(name: str) -> Column:
        return F.lpad(F.col(name).cast("string"), 4, "0")

    def whole(name: str) -> Column:
        return F.col(name).cast("long").cast("string")

    columns = {
        "FL_DATE": F.when(order % 113 == 0, "not-a-date").when(order % 127 == 0, "").otherwise(day),
        "OP_UNIQUE_CARRIER": F.when(order % 131 == 0, F.lit(None)).otherwise(F.col("OP_UNIQUE_CARRIER")),
        "CRS_DEP_TIME": F.when(order % 137 == 0, "2575")
        .when(order % 139 == 0, "800.5")
        .otherwise(clock("CRS_DEP_TIME")),
        "CRS_ARR_TIME": F.when(order % 149 == 0, "2000000000").otherwise(clock("CRS_ARR_TIME")),
        "CRS_ELAPSED_TIME": F.when(order % 151 == 0, "inf").otherwise(whole("CRS_ELAPSED_TIME")),
        "DISTANCE": F.when(order % 157 == 0, "abc")
        .when(order % 163 == 0, "-10")
        .otherwise(whole("DISTANCE")),
        "predicted_arr_delay": F.when(order % 167 == 0, "oops")
        .when(order % 173 == 0, "nan")
        .otherwise(F.col("predicted_arr_delay").cast("string")),
    }
    for place in ("ORIGIN", "DEST"):
        if place in df.columns:
            columns[place] = F.col(place)
    if "ORIGIN" in df.columns:
        columns["ORIGIN"] = F.when(order % 179 == 0, "  ").otherwise(F.col("ORIGIN"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return df.select(
        *(c.alias(n) for n, c in columns.items()),
        *keys,
        F.col("DISTANCE").alias("file_order"),
        *also,
    )
