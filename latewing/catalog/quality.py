"""Ingest, cleaning and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import quality as Q
from ..operators.features import with_features
from ..operators.split import labelled_split
from ..schema import MODEL_FEATURES
from ..session import new_folder
from ..sources import files
from ..sources.sinks import export_csv
from ..sources.trips import RECORD_KEY, raw_facts, text_trips, trip_facts, trips, with_places
from .registry import CLEAN, FACT_TEXT, FACTS, RECORD_ORDER, TEXT, TRIPS, USABLE, date_sql, finite_sql, hhmm_sql, query

ROW_LABEL = "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
FILE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "file_order"]


def _row_label(order, line, part, supplier, _):
    return F.concat_ws("/", *(c.cast("string") for c in (order, line, part, supplier)))


def _text(spark, folder):
    return text_trips(trips(spark, folder))


def _fact_text(spark, folder):
    """For what reads no places: a projection of the record table."""
    return text_trips(trip_facts(spark, folder))


@query("row_count", f"WITH {FACT_TEXT} SELECT count(*) AS rows FROM text")
def row_count(spark, folder):
    written = new_folder(spark, "text")
    export_csv(_fact_text(spark, folder), written)
    return files.read_text(spark, written).agg(F.count("*").alias("rows"))


@query(
    "csv_roundtrip",
    f"""WITH {FACTS}, raw AS (SELECT *, CASE WHEN l_orderkey % 101 = 0 THEN year(FL_DATE) + 1 ELSE year(FL_DATE) END AS YEAR,
 CASE WHEN l_orderkey % 103 = 0 THEN 0 ELSE month(FL_DATE) END AS MONTH FROM facts)
SELECT CAST(YEAR AS BIGINT) AS YEAR, CAST(MONTH AS BIGINT) AS MONTH, count(*) AS n, count(ARR_DELAY) AS known,
sum(ARR_DELAY) AS delay_sum, count(CASE WHEN MONTH > 6 THEN 1 END) AS notes, CAST(0 AS BIGINT) AS corrupt
FROM raw GROUP BY ALL""",
)
def csv_roundtrip(spark, folder):
    """Monthly files with two headers, one with a column more and line breaks in its cells, read as one table."""
    raw = raw_facts(spark, folder).select("YEAR", "MONTH", "OP_UNIQUE_CARRIER", "ARR_DELAY", "DISTANCE")
    written = new_folder(spark, "months")
    export_csv(raw.where("MONTH <= 6"), f"{written}/early")
    late = raw.where("MONTH > 6").withColumn("NOTE", F.concat(F.lit('said "late",\n'), "OP_UNIQUE_CARRIER"))
    export_csv(late.select(*reversed(late.columns)), f"{written}/late")
    whole = files.read_records(spark, f"{written}/*", corrupt="unread")
    noted = F.col("NOTE") == F.concat(F.lit('said "late",\n'), "OP_UNIQUE_CARRIER")
    return whole.groupBy("YEAR", "MONTH").agg(
        F.count("*").alias("n"),
        F.count("ARR_DELAY").alias("known"),
        F.sum("ARR_DELAY").alias("delay_sum"),
        F.count_if(noted).alias("notes"),
        F.count("unread").alias("corrupt"),
    )


@query(
    "valid_predictions",
    f"""WITH {FACT_TEXT}, valid AS (SELECT {date_sql('FL_DATE')} AS d, OP_UNIQUE_CARRIER,
 {finite_sql('predicted_arr_delay')} AS p FROM text)
SELECT OP_UNIQUE_CARRIER, strftime(d, '%Y-%m-%d') AS FL_DATE, count(*) AS n, sum(p) AS delay_sum
FROM valid WHERE p IS NOT NULL GROUP BY ALL""",
)
def valid_predictions(spark, folder):
    valid = files.valid_predictions(_fact_text(spark, folder))
    return valid.groupBy("OP_UNIQUE_CARRIER", "FL_DATE").agg(
        F.count("*").alias("n"), F.sum("predicted_arr_delay").alias("delay_sum")
    )


@query(
    "load_notes",
    f"""WITH {FACT_TEXT}, v AS (SELECT {date_sql('FL_DATE')} AS d, {finite_sql('predicted_arr_delay')} AS p FROM text)
SELECT count(*) AS file_rows, count(*) - count(p) AS invalid_predictions,
count(*) FILTER (p IS NOT NULL AND d IS NULL) AS invalid_dates FROM v""",
)
def load_notes(spark, folder):
    return files.load_notes(_fact_text(spark, folder))


@query(
    "union_months",
    f"""WITH {FACTS}, raw AS (SELECT *, CASE WHEN l_orderkey % 101 = 0 THEN year(FL_DATE) + 1 ELSE year(FL_DATE) END AS YEAR,
 CASE WHEN l_orderkey % 103 = 0 THEN 0 ELSE month(FL_DATE) END AS MONTH FROM facts)
SELECT CAST(YEAR AS BIGINT) AS YEAR, CAST(MONTH AS BIGINT) AS MONTH, count(*) AS n,
count(CASE WHEN MONTH <= 6 THEN DIVERTED END) AS diverted_known FROM raw GROUP BY ALL""",
)
def union_months(spark, folder):
    raw = raw_facts(spark, folder)
    whole = files.union_months(raw.where("MONTH <= 6"), raw.where("MONTH > 6").drop("DIVERTED"))
    return whole.groupBy("YEAR", "MONTH").agg(F.count("*").alias("n"), F.count("DIVERTED").alias("diverted_known"))


@query(
    "clean_filters",
    f"""WITH {FACTS} SELECT OP_UNIQUE_CARRIER, count(*) AS n, sum(ARR_DELAY) AS delay_sum,
CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM facts WHERE {USABLE} GROUP BY 1""",
)
def clean_filters(spark, folder):
    return C.usable_rows(trip_facts(spark, folder)).groupBy("OP_UNIQUE_CARRIER").agg(
        F.count("*").alias("n"), F.sum("ARR_DELAY").alias("delay_sum"), F.sum("l_orderkey").alias("key_sum")
    )


@query(
    "iqr_bounds",
    f"""WITH {FACTS}, q AS (SELECT quantile_cont(ARR_DELAY, 0.25) AS q1, quantile_cont(ARR_DELAY, 0.75) AS q3
FROM facts WHERE {USABLE}) SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q""",
)
def iqr_bounds(spark, folder):
    return C.quartile_bounds(C.usable_rows(trip_facts(spark, folder)))


@query(
    "clean_iqr",
    f"""WITH {CLEAN} SELECT ORIGIN, DEST, count(*) AS n, sum(ARR_DELAY) AS delay_sum, min(ARR_DELAY) AS least,
max(ARR_DELAY) AS most FROM clean GROUP BY ALL""",
)
def clean_iqr(spark, folder):
    return with_places(C.clean(trip_facts(spark, folder)), folder).groupBy("ORIGIN", "DEST").agg(
        F.count("*").alias("n"),
        F.sum("ARR_DELAY").alias("delay_sum"),
        F.min("ARR_DELAY").alias("least"),
        F.max("ARR_DELAY").alias("most"),
    )


# SQL condition of every rule, in report order.
_RULES = {
    **{f"{c}_numeric": (c, f"({hhmm_sql(c)}) IS NULL") for c in ("CRS_DEP_TIME", "CRS_ARR_TIME")},
    **{f"{c}_numeric": (c, f"({finite_sql(c)}) IS NULL") for c in ("CRS_ELAPSED_TIME", "DISTANCE")},
    **{f"{c}_blank": (c, f"({c} IS NULL OR trim({c}) = '')") for c in ("OP_UNIQUE_CARRIER", "ORIGIN", "DEST")},
    "FL_DATE_date": ("FL_DATE", f"{date_sql('FL_DATE')} IS NULL"),
    "CRS_DEP_TIME_clock": (
        "CRS_DEP_TIME",
        f"coalesce(({hhmm_sql('CRS_DEP_TIME')}) < 0 OR ({hhmm_sql('CRS_DEP_TIME')}) // 100 > 23 "
        f"OR ({hhmm_sql('CRS_DEP_TIME')}) % 100 > 59, FALSE)",
    ),
    "DISTANCE_negative": ("DISTANCE", f"coalesce(({finite_sql('DISTANCE')}) < 0, FALSE)"),
}
_BUSINESS = {
    "DISTANCE_positive": ("DISTANCE", f"coalesce(({finite_sql('DISTANCE')}) <= 0, TRUE)"),
    "CRS_ELAPSED_TIME_positive": ("CRS_ELAPSED_TIME", f"coalesce(({finite_sql('CRS_ELAPSED_TIME')}) <= 0, TRUE)"),
    "ORIGIN_is_DEST": ("ORIGIN", "coalesce(ORIGIN = DEST, TRUE)"),
}


def _count_sql(rules: dict, names=None) -> str:
    chosen = {n: rules[n] for n in (names or rules)}
    view = TEXT if any(c in ("ORIGIN", "DEST") for c, _ in chosen.values()) else FACT_TEXT
    parts = [
        f"SELECT CAST({i + 1} AS BIGINT) AS position, '{n}' AS rule, '{c}' AS \"column\", "
        f"count(*) FILTER ({test}) AS broken FROM text"
        for i, (n, (c, test)) in enumerate(chosen.items())
    ]
    return f"WITH {view} " + " UNION ALL ".join(parts)


@query("dq_numeric", _count_sql(_RULES, [n for n in _RULES if n.endswith("_numeric")]))
def dq_numeric(spark, folder):
    return Q.rule_counts(_fact_text(spark, folder), Q.numeric_rules())


@query("dq_text_date", _count_sql(_RULES, [n for n in _RULES if n.endswith(("_blank", "_date"))]))
def dq_text_date(spark, folder):
    return Q.rule_counts(_text(spark, folder), [*Q.text_rules(), Q.date_rule()])


@query("dq_features", _count_sql(_RULES, ["CRS_DEP_TIME_clock", "DISTANCE_negative"]))
def dq_features(spark, folder):
    return Q.rule_counts(_fact_text(spark, folder), Q.feature_rules())


@query("dq_business", _count_sql(_BUSINESS))
def dq_business(spark, folder):
    return Q.rule_counts(_text(spark, folder), Q.business_rules())


_HITS = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{n}' AS rule, '{c}' AS \"column\", * FROM text WHERE {test}"
    for i, (n, (c, test)) in enumerate(_RULES.items())
)
_RULE_ROWS = ", ".join(f"({i + 1}, '{n}', '{c}')" for i, (n, (c, _)) in enumerate(_RULES.items()))


@query(
    "dq_report",
    f"""WITH {TEXT}, hits AS ({_HITS}), placed AS (SELECT rule, {ROW_LABEL} AS label, row_number() OVER (PARTITION BY rule
 ORDER BY {', '.join(FILE_ORDER)}) AS place FROM hits),
summed AS (SELECT rule, count(*) AS broken, string_agg(label, ', ' ORDER BY place) FILTER (place <= 5) AS examples
 FROM placed GROUP BY 1), rules(position, rule, "column") AS (VALUES {_RULE_ROWS})
SELECT CAST(r.position AS BIGINT) AS position, r.rule, r."column", coalesce(broken, 0) AS broken,
coalesce(examples, '') AS examples FROM rules r LEFT JOIN summed s ON r.rule = s.rule""",
)
def dq_report(spark, folder):
    return Q.quality_report(_text(spark, folder), Q.scoring_rules(), FILE_ORDER, _row_label)


_BROKEN_LIST = ", ".join(f"CASE WHEN {test} THEN '{n}' END" for n, (_, test) in _RULES.items())


@query(
    "quarantine_counts",
    f"""WITH {TEXT}, marked AS (SELECT concat_ws(',', {_BROKEN_LIST}) AS reasons FROM text)
SELECT CASE WHEN reasons = '' THEN 'good' ELSE 'quarantine' END AS sink, reasons, count(*) AS n FROM marked GROUP BY ALL""",
)
def quarantine_counts(spark, folder):
    # Both outputs are cut from the same flagged rows, so these are counted once.
    marked = Q.flagged(_text(spark, folder), Q.scoring_rules())
    reasons = F.array_join(Q.BROKEN, ",").alias("reasons")
    counted = marked.groupBy(reasons).agg(F.count("*").alias("n"))
    return counted.select(F.when(F.col("reasons") == "", "good").otherwise("quarantine").alias("sink"), "reasons", "n")


@query(
    "split_quality",
    f"""WITH {TRIPS}, ranked AS (SELECT *, row_number() OVER (ORDER BY {RECORD_ORDER}) AS r, count(*) OVER () AS n FROM trips)
SELECT CASE WHEN r <= floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
count(*) - count(ARR_DELAY) AS null_targets, CAST(0 AS BIGINT) AS null_cells FROM ranked GROUP BY 1""",
)
def split_quality(spark, folder):
    parts = with_places(labelled_split(trip_facts(spark, folder), RECORD_KEY), folder)
    return Q.split_quality(with_features(parts), features=MODEL_FEATURES)


_RAW = f"""{FACTS}, raw AS (SELECT *,
 CASE WHEN l_orderkey % 101 = 0 THEN year(FL_DATE) + 1 ELSE year(FL_DATE) END AS YEAR,
 CASE WHEN l_orderkey % 103 = 0 THEN 0 ELSE month(FL_DATE) END AS MONTH FROM facts)"""


@query(
    "date_consistency",
    f"""WITH {_RAW} SELECT count(*) FILTER (year(FL_DATE) <> YEAR) AS year_mismatches,
count(*) FILTER (month(FL_DATE) <> MONTH) AS month_mismatches,
count(*) FILTER (year(FL_DATE) <> YEAR OR month(FL_DATE) <> MONTH) AS row_mismatches FROM raw""",
)
def date_consistency(spark, folder):
    return Q.date_consistency(raw_facts(spark, folder))


@query(
    "date_mismatches",
    f"""WITH {_RAW} SELECT strftime(FL_DATE, '%Y-%m-%d %H:%M:%S') AS FL_DATE, CAST(YEAR AS BIGINT) AS YEAR,
CAST(year(FL_DATE) AS BIGINT) AS date_year, CAST(MONTH AS BIGINT) AS MONTH, CAST(month(FL_DATE) AS BIGINT) AS date_month,
l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, DISTANCE FROM raw WHERE year(FL_DATE) <> YEAR OR month(FL_DATE) <> MONTH
ORDER BY raw.FL_DATE, l_orderkey, l_linenumber, l_partkey, l_suppkey, DISTANCE LIMIT 20""",
)
def date_mismatches(spark, folder):
    return Q.date_mismatches(raw_facts(spark, folder), RECORD_KEY)


@query(
    "negative_duration",
    f"""WITH {FACTS} SELECT count(*) AS rows, count(*) FILTER (CRS_ELAPSED_TIME < 0) AS negative_rows,
round(count(*) FILTER (CRS_ELAPSED_TIME < 0) * 100.0 / count(*), 6) AS negative_percent,
count(*) FILTER (CRS_ELAPSED_TIME >= 0) AS kept_rows FROM facts""",
)
def negative_duration(spark, folder):
    return C.negative_durations(trip_facts(spark, folder))


@query(
    "negative_duration_examples",
    f"""WITH {TRIPS} SELECT strftime(FL_DATE, '%Y-%m-%d %H:%M:%S') AS FL_DATE, ORIGIN, DEST, CRS_ELAPSED_TIME, l_orderkey,
CAST(l_linenumber AS BIGINT) AS l_linenumber FROM trips WHERE CRS_ELAPSED_TIME < 0
ORDER BY trips.FL_DATE, l_orderkey, l_linenumber, l_partkey, l_suppkey, DISTANCE LIMIT 20""",
)
def negative_duration_examples(spark, folder):
    examples = with_places(C.negative_examples(trip_facts(spark, folder), ["FL_DATE", *RECORD_KEY]), folder)
    return examples.select("FL_DATE", "ORIGIN", "DEST", "CRS_ELAPSED_TIME", "l_orderkey", "l_linenumber")


@query(
    "kept_durations",
    f"""WITH {FACTS} SELECT OP_UNIQUE_CARRIER, count(*) AS rows, min(CRS_ELAPSED_TIME) AS shortest,
sum(CRS_ELAPSED_TIME) AS total FROM facts WHERE CRS_ELAPSED_TIME >= 0 GROUP BY 1""",
)
def kept_durations(spark, folder):
    kept = C.without_negative_durations(trip_facts(spark, folder))
    return kept.groupBy("OP_UNIQUE_CARRIER").agg(
        F.count("*").alias("rows"), F.min("CRS_ELAPSED_TIME").alias("shortest"), F.sum("CRS_ELAPSED_TIME").alias("total")
    )
