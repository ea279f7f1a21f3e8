"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse_date, parse_hhmm, round_half_even
from ..functions.numbers import finite_number, hhmm_number
from ..operators.features import clock_features, impute_zero, with_features
from ..schema import NUMERIC_FEATURES
from ..sources.trips import text_trips, trip_facts, trips
from .registry import FACT_TEXT, FACTS, TRIPS, date_sql, finite_sql, hhmm_sql, query

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"

# One SQL expression per feature, over a view with the raw columns.
_SQL = {
    "year": "CAST(year(FL_DATE) AS BIGINT)",
    "month": "CAST(month(FL_DATE) AS BIGINT)",
    "quarter": "CAST(quarter(FL_DATE) AS BIGINT)",
    "day": "CAST(day(FL_DATE) AS BIGINT)",
    "day_of_week": "CAST(isodow(FL_DATE) - 1 AS BIGINT)",
    "week_of_year": "CAST(week(FL_DATE) AS BIGINT)",
    "is_weekend": "CAST(CASE WHEN isodow(FL_DATE) >= 6 THEN 1 ELSE 0 END AS BIGINT)",
    "departure_hour": "CAST(CRS_DEP_TIME // 100 AS BIGINT)",
    "departure_minute": "CAST(CRS_DEP_TIME % 100 AS BIGINT)",
    "departure_time_minutes": "CAST(CRS_DEP_TIME // 100 * 60 + CRS_DEP_TIME % 100 AS BIGINT)",
    "arrival_hour": "CAST(CRS_ARR_TIME // 100 AS BIGINT)",
    "arrival_minute": "CAST(CRS_ARR_TIME % 100 AS BIGINT)",
    "arrival_time_minutes": "CAST(CRS_ARR_TIME // 100 * 60 + CRS_ARR_TIME % 100 AS BIGINT)",
    "departure_hour_sin": "round(sin(2 * pi() * (CRS_DEP_TIME // 100) / 24), 6) + 0.0",
    "departure_hour_cos": "round(cos(2 * pi() * (CRS_DEP_TIME // 100) / 24), 6) + 0.0",
    "day_of_week_sin": "round(sin(2 * pi() * (isodow(FL_DATE) - 1) / 7), 6) + 0.0",
    "day_of_week_cos": "round(cos(2 * pi() * (isodow(FL_DATE) - 1) / 7), 6) + 0.0",
    "month_sin": "round(sin(2 * pi() * month(FL_DATE) / 12), 6) + 0.0",
    "month_cos": "round(cos(2 * pi() * month(FL_DATE) / 12), 6) + 0.0",
    "route": "concat(ORIGIN, '_', DEST)",
    "carrier_origin": "concat(OP_UNIQUE_CARRIER, '_', ORIGIN)",
    "departure_period": """CASE WHEN CRS_DEP_TIME // 100 <= 6 THEN 'night' WHEN CRS_DEP_TIME // 100 <= 12
 THEN 'morning' WHEN CRS_DEP_TIME // 100 <= 18 THEN 'afternoon' ELSE 'evening' END""",
    "distance_log": "round(ln(1 + DISTANCE), 6)",
    "is_peak_departure": """CAST(CASE WHEN CRS_DEP_TIME // 100 BETWEEN 7 AND 9
 OR CRS_DEP_TIME // 100 BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS BIGINT)""",
}


def _counted(view: str, source: str, keys: list[str], names: list[str]) -> str:
    shown = [*keys, *(f"{_SQL[n]} AS {n}" for n in names)]
    return f"WITH {view} SELECT {', '.join(shown)}, count(*) AS n FROM {source} GROUP BY ALL"


def _count_by(df, *names):
    return df.groupBy(*names).agg(F.count("*").alias("n"))


_DAY = "strftime(FL_DATE, '%Y-%m-%d') AS FL_DATE"
_CALENDAR = ["year", "month", "quarter", "day", "day_of_week", "week_of_year", "is_weekend"]
_CLOCK = [
    "departure_hour",
    "departure_minute",
    "departure_time_minutes",
    "arrival_hour",
    "arrival_minute",
    "arrival_time_minutes",
]
_CIRCLE = [
    "departure_hour_sin",
    "departure_hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
    "month_sin",
    "month_cos",
]


def _facts_with_places(spark, folder):
    """Facts with constant places: features that use no place need no join."""
    return trip_facts(spark, folder).withColumns({"ORIGIN": F.lit(""), "DEST": F.lit("")})


@query(
    "feat_departure",
    f"""WITH {FACTS} SELECT strftime(date_trunc('day', FL_DATE) + to_hours(CRS_DEP_TIME // 100)
 + to_minutes(CRS_DEP_TIME % 100), '%Y-%m-%d %H:%M:%S') AS scheduled_departure, count(*) AS n
FROM facts GROUP BY ALL""",
)
def feat_departure(spark, folder):
    return _count_by(with_features(_facts_with_places(spark, folder)), "scheduled_departure")


@query("feat_calendar", _counted(FACTS, "facts", [_DAY], _CALENDAR))
def feat_calendar(spark, folder):
    df = with_features(_facts_with_places(spark, folder))
    return _count_by(df, F.col("FL_DATE").cast("date").alias("FL_DATE"), *_CALENDAR)


@query("feat_time", _counted(FACTS, "facts", [], _CLOCK))
def feat_time(spark, folder):
    return _count_by(with_features(_facts_with_places(spark, folder)), *_CLOCK)


@query("feat_cyclical", _counted(FACTS, "facts", [], ["departure_hour", "day_of_week", "month", *_CIRCLE]))
def feat_cyclical(spark, folder):
    # Counted by the whole numbers first; the circle values follow from them.
    df = with_features(_facts_with_places(spark, folder))
    return df.groupBy("departure_hour", "day_of_week", "month").agg(
        *(F.first(c).alias(c) for c in _CIRCLE), F.count("*").alias("n")
    )


@query(
    "feat_categorical",
    _counted(TRIPS, "trips", ["OP_UNIQUE_CARRIER"], ["departure_hour", "route", "carrier_origin", "departure_period"]),
)
def feat_categorical(spark, folder):
    df = with_features(trips(spark, folder))
    return _count_by(df, "OP_UNIQUE_CARRIER", "departure_hour", "route", "carrier_origin", "departure_period")


@query("feat_numeric", _counted(FACTS, "facts", ["DISTANCE"], ["departure_hour", "distance_log", "is_peak_departure"]))
def feat_numeric(spark, folder):
    df = with_features(_facts_with_places(spark, folder))
    return df.groupBy("DISTANCE", "departure_hour").agg(
        F.first("distance_log").alias("distance_log"),
        F.first("is_peak_departure").alias("is_peak_departure"),
        F.count("*").alias("n"),
    )


@query(
    "feature_table",
    f"""WITH {TRIPS} SELECT {KEYS_SQL}, OP_UNIQUE_CARRIER, ORIGIN, DEST, CRS_ELAPSED_TIME, DISTANCE,
{', '.join(f'{sql} AS {name}' for name, sql in _SQL.items())} FROM trips""",
)
def feature_table(spark, folder):
    df = with_features(trips(spark, folder))
    return df.select(*KEYS, "OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "CRS_ELAPSED_TIME", "DISTANCE", *_SQL)


@query(
    "parse_dates",
    f"""WITH {FACT_TEXT} SELECT FL_DATE AS given, strftime({date_sql('FL_DATE')}, '%Y-%m-%d') AS parsed,
count(*) AS n FROM text GROUP BY ALL""",
)
def parse_dates(spark, folder):
    df = text_trips(trip_facts(spark, folder))
    return _count_by(df, F.col("FL_DATE").alias("given"), parse_date(F.col("FL_DATE")).alias("parsed"))


@query(
    "parse_hhmm",
    f"""WITH {FACT_TEXT} SELECT CRS_DEP_TIME AS given,
strftime(try_strptime(CASE WHEN length(CRS_DEP_TIME) = 4 THEN CRS_DEP_TIME END, '%H%M'), '%H:%M') AS parsed,
count(*) AS n FROM text GROUP BY ALL""",
)
def parse_clock(spark, folder):
    df = text_trips(trip_facts(spark, folder))
    return _count_by(df, F.col("CRS_DEP_TIME").alias("given"), parse_hhmm(F.col("CRS_DEP_TIME")).alias("parsed"))


@query(
    "round2",
    f"""WITH {FACTS} SELECT predicted_arr_delay * 0.125 AS x, round_even(predicted_arr_delay * 0.125, 2) AS rounded,
count(*) AS n FROM facts GROUP BY ALL""",
)
def round2(spark, folder):
    x = F.col("predicted_arr_delay") * 0.125
    return _count_by(trip_facts(spark, folder), x.alias("x"), round_half_even(x).alias("rounded"))


@query(
    "impute_zero",
    f"""WITH {FACT_TEXT}, typed AS (SELECT OP_UNIQUE_CARRIER, coalesce({finite_sql('DISTANCE')}, 0) AS DISTANCE,
coalesce({finite_sql('CRS_ELAPSED_TIME')}, 0) AS CRS_ELAPSED_TIME FROM text)
SELECT OP_UNIQUE_CARRIER, CAST(sum(CASE WHEN DISTANCE = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_distance,
sum(DISTANCE) AS distance, sum(CRS_ELAPSED_TIME) AS elapsed FROM typed GROUP BY 1""",
)
def imputed(spark, folder):
    typed = text_trips(trip_facts(spark, folder)).select(
        "OP_UNIQUE_CARRIER",
        finite_number(F.col("DISTANCE")).alias("DISTANCE"),
        finite_number(F.col("CRS_ELAPSED_TIME")).alias("CRS_ELAPSED_TIME"),
    )
    return (
        impute_zero(typed, NUMERIC_FEATURES)
        .groupBy("OP_UNIQUE_CARRIER")
        .agg(
            F.count_if(F.col("DISTANCE") == 0).alias("zero_distance"),
            F.sum("DISTANCE").alias("distance"),
            F.sum("CRS_ELAPSED_TIME").alias("elapsed"),
        )
    )


@query(
    "hhmm_roundtrip",
    f"""WITH {FACT_TEXT}, clock AS (SELECT {hhmm_sql('CRS_ARR_TIME')} AS hhmm FROM text)
SELECT hhmm, CAST(hhmm // 100 AS BIGINT) AS hour, CAST(hhmm % 100 AS BIGINT) AS minute,
CAST(hhmm // 100 * 100 + hhmm % 100 AS BIGINT) AS packed, count(*) AS n FROM clock GROUP BY ALL""",
)
def hhmm_roundtrip(spark, folder):
    df = text_trips(trip_facts(spark, folder)).select(hhmm_number(F.col("CRS_ARR_TIME")).alias("hhmm"))
    parts = clock_features("c", F.col("hhmm"))
    return (
        df.withColumns({"hour": parts["c_hour"], "minute": parts["c_minute"]})
        .withColumn("packed", F.col("hour") * 100 + F.col("minute"))
        .groupBy("hhmm", "hour", "minute", "packed")
        .agg(F.count("*").alias("n"))
    )
