"""Registry of queries and the shared SQL views of their counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its result is brought to types both engines print alike."""

    def keep(build: Callable[[SparkSession, str], DataFrame]):
        CATALOG[name] = Entry(lambda spark, folder: portable(build(spark, folder), digits), sql)
        return build

    return keep


def portable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, doubles rounded, dates and times as text."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            column = column.cast("bigint")
        elif kind == "double":
            column = F.round(column, digits) + F.lit(0.0)
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(name))
    return df.select(*columns)


_FACTS = """
 l.l_shipdate AS FL_DATE,
 concat('C', CAST(l.l_suppkey % 10 AS VARCHAR)) AS OP_UNIQUE_CARRIER,
 CAST((l.l_partkey % 24) * 100 + l.l_orderkey % 60 AS INT) AS CRS_DEP_TIME,
 CAST(((l.l_partkey + l.l_suppkey) % 24) * 100 + (l.l_orderkey + l.l_linenumber) % 60 AS INT) AS CRS_ARR_TIME,
 CAST(l.l_partkey % 310 - 5 AS DOUBLE) AS CRS_ELAPSED_TIME,
 l.l_quantity * 50 AS DISTANCE,
 CASE WHEN l.l_orderkey % 50 = 0 THEN 1.0E0 ELSE 0.0E0 END AS CANCELLED,
 CASE WHEN l.l_orderkey % 97 = 0 THEN 1.0E0 ELSE 0.0E0 END AS DIVERTED,
 CASE WHEN l.l_orderkey % 50 = 0 OR l.l_orderkey % 97 = 0 OR l.l_partkey % 211 = 0 THEN NULL
  ELSE CAST((l.l_partkey * 31 + l.l_orderkey * 17 + l.l_linenumber * 7) % 60 - 25 + (l.l_partkey % 24)
   + 2 * (l.l_suppkey % 10) + CASE WHEN l.l_orderkey % 23 = 0 THEN 200 ELSE 0 END AS DOUBLE) END AS ARR_DELAY,
 l.l_quantity - 5 + (l.l_suppkey % 10) - (l.l_partkey % 24) * 0.5E0 AS predicted_arr_delay,
 l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
"""

FACTS = f"facts AS (SELECT {_FACTS} FROM lineitem l)"

TRIPS = f"""trips AS (
 SELECT sn.n_name AS ORIGIN, cn.n_name AS DEST, {_FACTS}
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN nation cn ON cu.c_nationkey = cn.n_nationkey
 JOIN supplier su ON l.l_suppkey = su.s_suppkey JOIN nation sn ON su.s_nationkey = sn.n_nationkey)"""


def text_view(source: str, places: bool) -> str:
    place = (
        "CASE WHEN l_orderkey % 179 = 0 THEN '  ' ELSE ORIGIN END AS ORIGIN, DEST,"
        if places
        else ""
    )
    return f"""text AS (
 SELECT CASE WHEN l_orderkey % 113 = 0 THEN 'not-a-date' WHEN l_orderkey % 127 = 0 THEN ''
   WHEN l_orderkey % 7 = 0 THEN strftime(FL_DATE, '%-m/%-d/%Y %I:%M:%S %p')
   ELSE strftime(FL_DATE, '%Y-%m-%d') END AS FL_DATE,
  CASE WHEN l_orderkey % 131 = 0 THEN NULL ELSE OP_UNIQUE_CARRIER END AS OP_UNIQUE_CARRIER, {place}
  CASE WHEN l_orderkey % 137 = 0 THEN '2575' WHEN l_orderkey % 139 = 0 THEN '800.5'
   ELSE lpad(CAST(CRS_DEP_TIME AS VARCHAR), 4, '0') END AS CRS_DEP_TIME,
  CASE WHEN l_orderkey % 149 = 0 THEN '2000000000'
   ELSE lpad(CAST(CRS_ARR_TIME AS VARCHAR), 4, '0') END AS CRS_ARR_TIME,
  CASE WHEN l_orderkey % 151 = 0 THEN 'inf' ELSE CAST(CAST(CRS_ELAPSED_TIME AS BIGINT) AS VARCHAR) END
   AS CRS_ELAPSED_TIME,
  CASE WHEN l_orderkey % 157 = 0 THEN 'abc' WHEN l_orderkey % 163 = 0 THEN '-10'
   ELSE CAST(CAST(DISTANCE AS BIGINT) AS VARCHAR) END AS DISTANCE,
  CASE WHEN l_orderkey % 167 = 0 THEN 'oops' WHEN l_orderkey % 173 = 0 THEN 'nan'
   ELSE CAST(predicted_arr_delay AS VARCHAR) END AS predicted_arr_delay,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, DISTANCE AS file_order
 FROM {source})"""


TEXT = f"{TRIPS}, {text_view('trips', True)}"
FACT_TEXT = f"{FACTS}, {text_view('facts', False)}"


def date_sql(column: str) -> str:
    return (
        f"CAST(coalesce(try_strptime({column}, '%Y-%m-%d'), "
        f"try_strptime({column}, '%m/%d/%Y %I:%M:%S %p')) AS DATE)"
    )


def finite_sql(column: str) -> str:
    number = f"TRY_CAST({column} AS DOUBLE)"
    return f"CASE WHEN isfinite({number}) THEN {number} END"


def hhmm_sql(column: str) -> str:
    number = f"({finite_sql(column)})"
    return f"CASE WHEN {number} = floor({number}) AND abs({number}) <= 1e9 THEN CAST({number} AS BIGINT) END"


USABLE = "CANCELLED = 0 AND DIVERTED = 0 AND CRS_ELAPSED_TIME > 0 AND ARR_DELAY IS NOT NULL"


def clean_view(view: str, source: str) -> str:
    return f"""{view}, usable AS (SELECT * FROM {source} WHERE {USABLE}),
quartiles AS (SELECT quantile_cont(ARR_DELAY, 0.25) AS q1, quantile_cont(ARR_DELAY, 0.75) AS q3 FROM usable),
clean AS (SELECT u.* FROM usable u, quartiles
 WHERE ARR_DELAY BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


CLEAN = clean_view(TRIPS, "trips")

RECORD_ORDER = "FL_DATE, l_orderkey, l_linenumber, l_partkey, l_suppkey, DISTANCE"
