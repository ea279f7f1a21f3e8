"""Column names, types and fixed values shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names, category bounds and bucket bounds are part of
# --- the data contract and must not change.

TARGET = "ARR_DELAY"
PREDICTION = "predicted_arr_delay"
DATE = "FL_DATE"
CARRIER = "OP_UNIQUE_CARRIER"
ORIGIN = "ORIGIN"
DEST = "DEST"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("YEAR", T.IntegerType()),
        T.StructField("QUARTER", T.IntegerType()),
        T.StructField("MONTH", T.IntegerType()),
        T.StructField("FL_DATE", T.StringType()),
        T.StructField("OP_UNIQUE_CARRIER", T.StringType()),
        T.StructField("ORIGIN_AIRPORT_ID", T.IntegerType()),
        T.StructField("ORIGIN", T.StringType()),
        T.StructField("DEST_AIRPORT_ID", T.IntegerType()),
        T.StructField("DEST", T.StringType()),
        T.StructField("CRS_DEP_TIME", T.StringType()),
        T.StructField("CRS_ARR_TIME", T.StringType()),
        T.StructField("ARR_DELAY", T.DoubleType()),
        T.StructField("CANCELLED", T.DoubleType()),
        T.StructField("DIVERTED", T.DoubleType()),
        T.StructField("CRS_ELAPSED_TIME", T.DoubleType()),
        T.StructField("DISTANCE", T.DoubleType()),
    ]
)

REQUIRED_COLUMNS = (
    "CRS_ARR_TIME",
    "CRS_DEP_TIME",
    "CRS_ELAPSED_TIME",
    "DEST",
    "DISTANCE",
    "FL_DATE",
    "OP_UNIQUE_CARRIER",
    "ORIGIN",
)

HHMM_COLUMNS = ("CRS_DEP_TIME", "CRS_ARR_TIME")
MEASURE_COLUMNS = ("CRS_ELAPSED_TIME", "DISTANCE")
TEXT_COLUMNS = ("OP_UNIQUE_CARRIER", "ORIGIN", "DEST")

CLEANING_COLUMNS = ("ARR_DELAY", "CANCELLED", "CRS_ELAPSED_TIME", "DIVERTED")

# Columns of a scored file that the analysis reads; all but the last are optional.
ANALYSIS_COLUMNS = (
    "FL_DATE",
    "OP_UNIQUE_CARRIER",
    "ORIGIN",
    "DEST",
    "CRS_DEP_TIME",
    "CRS_ARR_TIME",
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "predicted_arr_delay",
)

CATEGORICAL_FEATURES = (
    "OP_UNIQUE_CARRIER",
    "ORIGIN",
    "DEST",
    "route",
    "departure_period",
    "carrier_origin",
)

NUMERIC_FEATURES = (
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "year",
    "month",
    "quarter",
    "day",
    "day_of_week",
    "week_of_year",
    "is_weekend",
    "departure_hour",
    "departure_minute",
    "departure_time_minutes",
    "arrival_hour",
    "arrival_minute",
    "arrival_time_minutes",
    "departure_hour_sin",
    "departure_hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
    "month_sin",
    "month_cos",
    "distance_log",
    "is_peak_departure",
)

MODEL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES

# Severity classes: (label, inclusive upper bound in minutes); None = no bound.
SEVERITY_CLASSES = (
    ("On Time", 0.0),
    ("Minor Delay", 15.0),
    ("Moderate Delay", 30.0),
    ("Severe Delay", None),
)
DELAY_THRESHOLD = 15.0
HISTOGRAM_BINS = 50
PREVIEW_ROWS = 1_000
DEFAULT_TOP_N = 10

MISSING_CATEGORY = "__MISSING__"
RANDOM_SEED = 42
TEST_SHARE = 0.2

# Upper bounds in seconds of the job-duration histogram.
DURATION_BOUNDS = (1, 5, 10, 30, 60, 120, 300, 600, 1800, 3600)

# Shapes of date text that are accepted: those a plain cast reads, with the type
# to cast to, and the others, with their parse pattern.
DATE_CASTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "date"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}(\.\d{1,6})?$", "timestamp_ntz"),
)
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{8}$", "yyyyMMdd"),
)


class InputError(ValueError):
    """The given data cannot be used; the message names columns and rows."""


def missing_columns(columns, required=REQUIRED_COLUMNS) -> list[str]:
    present = set(columns)
    return sorted(c for c in required if c not in present)


def require_columns(columns, required=REQUIRED_COLUMNS) -> None:
    missing = missing_columns(columns, required)
    if missing:
        raise InputError("Missing required columns: " + ", ".join(missing))
