"""Summary queries over scored trips and the exploratory statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import severity
from ..operators import analysis as A
from ..operators import cube
from ..operators import profile as P
from ..operators.distribution import equal_share_bucket, group_statistics
from ..operators.features import with_features
from ..plans.analysis import run_analysis as whole_analysis
from ..schema import ANALYSIS_COLUMNS, PREDICTION, SEVERITY_CLASSES
from ..session import new_folder, staged
from ..sources.trips import FACT_COLUMNS, trip_facts, trips
from .registry import FACTS, TRIPS, query

_KPI_SQL = """SELECT count(*) AS total_flights, round(avg(predicted_arr_delay), 6) AS average,
 round(median(predicted_arr_delay), 6) AS median, max(predicted_arr_delay) AS maximum,
 min(predicted_arr_delay) AS minimum,
 round(avg(CASE WHEN predicted_arr_delay > 15 THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent_over_threshold"""

_FILTERS = A.Filters(
    carriers=("C1", "C2", "C3"),
    origins=tuple(f"NATION_{i}" for i in range(0, 25, 2)),
    destinations=tuple(f"NATION_{i}" for i in range(1, 25, 2)),
    date_range=(date(1996, 1, 1), date(1998, 12, 31)),
)


def _filter_sql() -> str:
    def listed(values):
        return ", ".join(f"'{v}'" for v in values)

    first, last = _FILTERS.date_range
    return (
        f"OP_UNIQUE_CARRIER IN ({listed(_FILTERS.carriers)}) AND ORIGIN IN ({listed(_FILTERS.origins)}) "
        f"AND DEST IN ({listed(_FILTERS.destinations)}) AND FL_DATE BETWEEN DATE '{first}' AND DATE '{last}'"
    )


@query("kpis", f"WITH {FACTS} {_KPI_SQL} FROM facts")
def kpis(spark, folder):
    return A.kpis(trip_facts(spark, folder))


@query("kpis_empty", f"WITH {FACTS} {_KPI_SQL} FROM facts WHERE OP_UNIQUE_CARRIER = 'none'")
def kpis_empty(spark, folder):
    return A.kpis(A.apply_filters(trip_facts(spark, folder), A.Filters(carriers=("none",))))


@query("filtered_kpis", f"WITH {TRIPS} {_KPI_SQL} FROM trips WHERE {_filter_sql()}")
def filtered_kpis(spark, folder):
    return A.kpis(A.apply_filters(trips(spark, folder), _FILTERS))


@query("filtered_kpis_cube", f"WITH {TRIPS} {_KPI_SQL} FROM trips WHERE {_filter_sql()}")
def filtered_kpis_cube(spark, folder):
    """The same figures from the stored cube."""
    stored = new_folder(spark, "cube")
    cube.store_cube(trips(spark, folder), stored)
    return cube.cube_kpis(cube.read_cube(spark, stored, _FILTERS))


_LABEL_SQL = """CASE WHEN predicted_arr_delay <= 0 THEN 'On Time' WHEN predicted_arr_delay <= 15 THEN 'Minor Delay'
 WHEN predicted_arr_delay <= 30 THEN 'Moderate Delay' ELSE 'Severe Delay' END"""


@query("categorize", f"WITH {FACTS} SELECT predicted_arr_delay, {_LABEL_SQL} AS category, count(*) AS n FROM facts GROUP BY ALL")
def categorize(spark, folder):
    df = trip_facts(spark, folder)
    return df.groupBy(PREDICTION, severity(F.col(PREDICTION)).alias("category")).agg(F.count("*").alias("n"))


_CLASS_ROWS = ", ".join(f"({i + 1}, '{name}')" for i, (name, _) in enumerate(SEVERITY_CLASSES))


@query(
    "category_summary",
    f"""WITH {FACTS}, labelled AS (SELECT {_LABEL_SQL} AS category FROM facts),
classes(position, category) AS (VALUES {_CLASS_ROWS})
SELECT CAST(c.position AS BIGINT) AS position, c.category, count(l.category) AS flights,
round(count(l.category) * 100.0 / (SELECT count(*) FROM labelled), 6) AS percentage
FROM classes c LEFT JOIN labelled l ON c.category = l.category GROUP BY ALL""",
)
def category_summary(spark, folder):
    return A.class_summary(trip_facts(spark, folder))


@query(
    "histogram",
    f"""WITH {FACTS}, reach AS (SELECT min(predicted_arr_delay) AS lo, max(predicted_arr_delay) AS hi,
 (max(predicted_arr_delay) - min(predicted_arr_delay)) / 50 AS w FROM facts),
bins AS (SELECT i AS bin, lo + i * w AS bin_start, CASE WHEN i = 49 THEN hi ELSE lo + (i + 1) * w END AS bin_end
 FROM reach, unnest(range(50)) AS t(i)),
counted AS (SELECT b.bin, count(*) AS n FROM facts f JOIN bins b ON f.predicted_arr_delay >= b.bin_start
 AND (f.predicted_arr_delay < b.bin_end OR b.bin = 49) GROUP BY 1)
SELECT CAST(b.bin AS BIGINT) AS bin, round(b.bin_start, 6) AS bin_start, round(b.bin_end, 6) AS bin_end,
coalesce(n, 0) AS flights FROM bins b LEFT JOIN counted c ON b.bin = c.bin""",
)
def histogram(spark, folder):
    return A.histogram(trip_facts(spark, folder))


def _group_sql(view: str, source: str, keys: dict[str, str], tail: str = "") -> str:
    names = ", ".join(f"{c} AS {n}" for c, n in keys.items())
    return (
        f"WITH {view} SELECT {names}, round(avg(predicted_arr_delay), 6) AS avg_predicted_delay, "
        f"count(predicted_arr_delay) AS flights FROM {source} GROUP BY ALL {tail}"
    )


@query("by_carrier", _group_sql(FACTS, "facts", {"OP_UNIQUE_CARRIER": "carrier"}))
def by_carrier(spark, folder):
    return A.by_carrier(trip_facts(spark, folder))


@query("by_origin", _group_sql(TRIPS, "trips", {"ORIGIN": "origin"}))
def by_origin(spark, folder):
    return A.by_origin(trips(spark, folder))


@query("by_destination", _group_sql(TRIPS, "trips", {"DEST": "destination"}))
def by_destination(spark, folder):
    return A.by_destination(trips(spark, folder))


_ROUTE_KEYS = {"concat(ORIGIN, ' → ', DEST)": "route", "ORIGIN": "origin", "DEST": "destination"}


@query("by_route", _group_sql(TRIPS, "trips", _ROUTE_KEYS))
def by_route(spark, folder):
    return A.by_route(trips(spark, folder))


_RANK = "avg(predicted_arr_delay) DESC, count(predicted_arr_delay) DESC"


@query("top_routes", _group_sql(TRIPS, "trips", _ROUTE_KEYS, f"ORDER BY {_RANK}, origin, destination LIMIT 10"))
def top_routes(spark, folder):
    return A.top_groups(A.by_route(trips(spark, folder)))


@query(
    "top_origins_min",
    _group_sql(
        TRIPS, "trips", {"ORIGIN": "origin"}, f"HAVING count(predicted_arr_delay) >= 2000 ORDER BY {_RANK}, origin LIMIT 5"
    ),
)
def top_origins_min(spark, folder):
    return A.top_groups(A.by_origin(trips(spark, folder)), 5, 2000)


@query("daily", _group_sql(FACTS, "facts", {"strftime(FL_DATE, '%Y-%m-%d')": "date"}))
def daily(spark, folder):
    return A.daily(trip_facts(spark, folder))


@query(
    "analysis_grouping_sets",
    f"""WITH {TRIPS}, long AS (
 SELECT 'carrier' AS section, OP_UNIQUE_CARRIER AS group_key, predicted_arr_delay AS p FROM trips
 UNION ALL SELECT 'origin', ORIGIN, predicted_arr_delay FROM trips
 UNION ALL SELECT 'destination', DEST, predicted_arr_delay FROM trips
 UNION ALL SELECT 'route', concat(ORIGIN, ' → ', DEST), predicted_arr_delay FROM trips
 UNION ALL SELECT 'day', strftime(FL_DATE, '%Y-%m-%d'), predicted_arr_delay FROM trips)
SELECT section, group_key, round(avg(p), 6) AS avg_predicted_delay, count(p) AS flights FROM long GROUP BY ALL""",
)
def analysis_grouping_sets(spark, folder):
    return A.all_groups(trips(spark, folder))


_GROUP_SQL = " UNION ALL ".join(
    f"SELECT '{section}', {key}, avg(predicted_arr_delay), count(predicted_arr_delay) FROM f GROUP BY 2"
    for section, key in (
        ("carriers", "OP_UNIQUE_CARRIER"), ("origins", "ORIGIN"), ("destinations", "DEST"),
        ("routes", "concat(ORIGIN, ' → ', DEST)"), ("daily", "strftime(FL_DATE, '%Y-%m-%d')"),
    )
)


@query(
    "run_analysis",
    f"""WITH {TRIPS}, f AS (SELECT * FROM trips WHERE {_filter_sql()}), k AS ({_KPI_SQL} FROM f),
reach AS (SELECT min(predicted_arr_delay) AS lo, max(predicted_arr_delay) AS hi,
 (max(predicted_arr_delay) - min(predicted_arr_delay)) / 50 AS w FROM f),
bins AS (SELECT i AS bin, lo + i * w AS bin_start, CASE WHEN i = 49 THEN hi ELSE lo + (i + 1) * w END AS bin_end
 FROM reach, unnest(range(50)) AS t(i)),
counted AS (SELECT b.bin, count(*) AS n FROM f JOIN bins b ON predicted_arr_delay >= b.bin_start
 AND (predicted_arr_delay < b.bin_end OR b.bin = 49) GROUP BY 1),
classes(position, category) AS (VALUES {_CLASS_ROWS}), labelled AS (SELECT {_LABEL_SQL} AS category FROM f),
rows(section, label, amount, flights) AS (
 SELECT 'kpis', 'average', average, total_flights FROM k UNION ALL SELECT 'kpis', 'median', median, total_flights FROM k
 UNION ALL SELECT 'kpis', 'maximum', maximum, total_flights FROM k UNION ALL SELECT 'kpis', 'minimum', minimum, total_flights FROM k
 UNION ALL SELECT 'kpis', 'percent_over_threshold', percent_over_threshold, total_flights FROM k
 UNION ALL SELECT 'histogram', CAST(b.bin AS VARCHAR), b.bin_start, coalesce(n, 0) FROM bins b LEFT JOIN counted c ON b.bin = c.bin
 UNION ALL SELECT 'categories', c.category, count(l.category) * 100.0 / (SELECT count(*) FROM f), count(l.category)
  FROM classes c LEFT JOIN labelled l ON c.category = l.category GROUP BY 2
 UNION ALL {_GROUP_SQL})
SELECT section, label, round(CAST(amount AS DOUBLE), 6) AS amount, CAST(flights AS BIGINT) AS flights FROM rows""",
)
def run_analysis(spark, folder):
    """Every table of the whole analysis of one filter selection, as rows of one table."""
    whole = whole_analysis(trips(spark, folder).select(*ANALYSIS_COLUMNS), _FILTERS)
    if whole.unavailable:
        raise ValueError(f"sections are missing: {whole.unavailable}")

    def rows(section, df, label, amount, flights):
        columns = {"section": F.lit(section), "label": label, "amount": amount, "flights": flights}
        return df.select(*(F.lit(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()))

    names = ("average", "median", "maximum", "minimum", "percent_over_threshold")
    figures = whole.kpis.select("total_flights", F.inline(F.array(*(
        F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("amount")) for n in names
    ))))
    label = {"routes": F.col("route"), "daily": F.date_format("date", "yyyy-MM-dd")}
    own = {"carriers": F.col("carrier"), "origins": F.col("origin"), "destinations": F.col("destination")}
    parts = [
        rows("kpis", figures, F.col("label"), F.col("amount"), F.col("total_flights")),
        rows("histogram", whole.histogram, F.col("bin").cast("string"), F.col("bin_start"), F.col("flights")),
        rows("categories", whole.categories, F.col("category"), F.col("percentage"), F.col("flights")),
        *(
            rows(section, df, (label | own)[section], F.col("avg_predicted_delay"), F.col("flights"))
            for section, df in whole.groups.items()
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    result = staged(result, "analysis")
    whole.close()
    return result


@query(
    "group_sums",
    f"""WITH {TRIPS} SELECT OP_UNIQUE_CARRIER, ORIGIN, DEST, strftime(FL_DATE, '%Y-%m-%d') AS FL_DATE,
sum(predicted_arr_delay) AS delay_sum, count(predicted_arr_delay) AS delay_rows FROM trips GROUP BY ALL""",
)
def group_sums(spark, folder):
    return A.group_sums(trips(spark, folder).withColumn("FL_DATE", F.col("FL_DATE").cast("date")))


@query(
    "filter_options",
    f"""WITH {TRIPS} SELECT DISTINCT 'carrier' AS option, OP_UNIQUE_CARRIER AS choice FROM trips
UNION ALL SELECT DISTINCT 'origin', ORIGIN FROM trips UNION ALL SELECT DISTINCT 'destination', DEST FROM trips
UNION ALL SELECT 'date_min', strftime(min(FL_DATE), '%Y-%m-%d') FROM trips
UNION ALL SELECT 'date_max', strftime(max(FL_DATE), '%Y-%m-%d') FROM trips""",
)
def filter_options(spark, folder):
    return A.filter_options(trips(spark, folder))


_WHOLE = ("CRS_DEP_TIME", "CRS_ARR_TIME", "l_linenumber")
_PREVIEW = ["ORIGIN", "DEST", *FACT_COLUMNS[1:6], "predicted_arr_delay", *FACT_COLUMNS[10:]]


@query(
    "preview",
    f"""WITH {TRIPS} SELECT strftime(FL_DATE, '%Y-%m-%d') AS FL_DATE,
{', '.join(f'CAST({c} AS BIGINT) AS {c}' if c in _WHOLE else c for c in _PREVIEW)} FROM trips
WHERE {_filter_sql()} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, trips.FL_DATE, DISTANCE LIMIT 1000""",
)
def preview(spark, folder):
    rows = A.apply_filters(trips(spark, folder), _FILTERS)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "FL_DATE", "DISTANCE"]
    shown = [F.col("FL_DATE").cast("date").alias("FL_DATE"), *_PREVIEW]
    return rows.orderBy(*order).limit(1000).select(*shown)


# --- exploratory statistics ----------------------------------------------------


def _eda_sql(view: str, source: str, key: str, name: str, tail: str = "") -> str:
    return (
        f"WITH {view} SELECT {key} AS {name}, count(ARR_DELAY) AS rows, round(avg(ARR_DELAY), 6) AS mean, "
        f"round(median(ARR_DELAY), 6) AS median FROM {source} WHERE ARR_DELAY IS NOT NULL GROUP BY 1 {tail}"
    )


def _eda(df, key, min_rows=1):
    return group_statistics(df, "ARR_DELAY", key, min_rows).select(key, "rows", "mean", "median")


def _timed(spark, folder):
    return with_features(trip_facts(spark, folder).withColumns({"ORIGIN": F.lit(""), "DEST": F.lit("")}))


@query("eda_by_hour", _eda_sql(FACTS, "facts", "CAST(CRS_DEP_TIME // 100 AS BIGINT)", "departure_hour"))
def eda_by_hour(spark, folder):
    return _eda(_timed(spark, folder), "departure_hour")


@query("eda_by_weekday", _eda_sql(FACTS, "facts", "CAST(isodow(FL_DATE) - 1 AS BIGINT)", "day_of_week"))
def eda_by_weekday(spark, folder):
    return _eda(_timed(spark, folder), "day_of_week")


@query("eda_by_carrier", _eda_sql(FACTS, "facts", "OP_UNIQUE_CARRIER", "OP_UNIQUE_CARRIER"))
def eda_by_carrier(spark, folder):
    return _eda(trip_facts(spark, folder), "OP_UNIQUE_CARRIER")


@query("eda_by_origin", _eda_sql(TRIPS, "trips", "ORIGIN", "ORIGIN"))
def eda_by_origin(spark, folder):
    return _eda(trips(spark, folder), "ORIGIN")


@query("eda_by_destination", _eda_sql(TRIPS, "trips", "DEST", "DEST"))
def eda_by_destination(spark, folder):
    return _eda(trips(spark, folder), "DEST")


@query("eda_min_group", _eda_sql(TRIPS, "trips", "ORIGIN", "ORIGIN", "HAVING count(ARR_DELAY) >= 500"))
def eda_min_group(spark, folder):
    return _eda(trips(spark, folder), "ORIGIN", 500)


def _decile_sql(column: str) -> str:
    shares = ", ".join(str(i / 10) for i in range(11))
    return f"""WITH {FACTS}, e AS (SELECT list_sort(list_distinct(quantile_cont({column}, [{shares}]))) AS edges FROM facts),
placed AS (SELECT greatest(len(list_filter(edges, lambda x: x < {column})), 1) AS bucket, ARR_DELAY FROM facts, e)
SELECT CAST(bucket AS BIGINT) AS bucket, count(ARR_DELAY) AS rows, round(avg(ARR_DELAY), 6) AS mean,
round(median(ARR_DELAY), 6) AS median FROM placed WHERE ARR_DELAY IS NOT NULL GROUP BY 1"""


@query("deciles_distance", _decile_sql("DISTANCE"))
def deciles_distance(spark, folder):
    return _eda(equal_share_bucket(trip_facts(spark, folder), "DISTANCE"), "bucket")


@query("deciles_duration", _decile_sql("CRS_ELAPSED_TIME"))
def deciles_duration(spark, folder):
    return _eda(equal_share_bucket(trip_facts(spark, folder), "CRS_ELAPSED_TIME"), "bucket")


_PROFILED = ("OP_UNIQUE_CARRIER", "ORIGIN", "DEST", "CRS_DEP_TIME", "DISTANCE", "ARR_DELAY")


@query(
    "profile",
    f"WITH {TRIPS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM trips"
        for c in _PROFILED
    ),
)
def profile(spark, folder):
    return P.column_profile(trips(spark, folder), _PROFILED).select("column", "nulls", "distinct_values")


@query(
    "profile_by_month",
    f"WITH {TRIPS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, TRUE AS within_error FROM trips"
        for c in _PROFILED
    ),
)
def profile_by_month(spark, folder):
    """Distinct counts merged from the quarters' own profiles, held against exact ones."""
    kept, facts = new_folder(spark, "profile"), trips(spark, folder)
    for quarter in range(1, 5):
        P.store_profile(facts.where(F.quarter("FL_DATE") == quarter).select(*_PROFILED), kept, f"q{quarter}")
    exact = P.column_profile(facts, _PROFILED).select("column", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    return P.merged_profile(spark, kept).join(exact, "column").select(
        "column", "rows", "nulls", (off <= F.ceil(4 * P.HLL_ERROR * F.col("exact"))).alias("within_error")
    )


@query(
    "table_shape",
    f"""WITH {FACTS}, g AS (SELECT OP_UNIQUE_CARRIER, CRS_DEP_TIME, DISTANCE, count(*) AS n FROM facts GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def table_shape(spark, folder):
    return P.table_shape(trip_facts(spark, folder), ["OP_UNIQUE_CARRIER", "CRS_DEP_TIME", "DISTANCE"])


@query("value_counts", f"WITH {TRIPS} SELECT ORIGIN AS value, count(*) AS rows FROM trips GROUP BY 1")
def value_counts(spark, folder):
    return P.value_frequencies(trips(spark, folder), "ORIGIN")


@query(
    "describe",
    f"""WITH {FACTS} SELECT count(ARR_DELAY) AS rows, round(avg(ARR_DELAY), 6) AS mean,
round(stddev_samp(ARR_DELAY), 6) AS std, min(ARR_DELAY) AS minimum, quantile_cont(ARR_DELAY, 0.25) AS q25,
quantile_cont(ARR_DELAY, 0.5) AS q50, quantile_cont(ARR_DELAY, 0.75) AS q75, max(ARR_DELAY) AS maximum FROM facts""",
)
def describe(spark, folder):
    return P.describe(trip_facts(spark, folder), "ARR_DELAY")
