import math
from datetime import date, datetime

import pytest
from helpers import text_frame, text_rows

from latewing.functions import parse_date, parse_hhmm, round_half_even
from latewing.operators.features import impute_zero, model_frame, with_features
from latewing.operators.split import fold_of
from latewing.schema import MODEL_FEATURES, InputError
from pyspark.sql import functions as F

ONE = [("2026-09-01", 830, 1145, 195.0, 2475.0, "AA", "JFK", "LAX")]
SCHEMA = (
    "FL_DATE string, CRS_DEP_TIME int, CRS_ARR_TIME int, CRS_ELAPSED_TIME double, DISTANCE double, "
    "OP_UNIQUE_CARRIER string, ORIGIN string, DEST string"
)


def test_every_model_feature_is_built(spark):
    row = model_frame(with_features(spark.createDataFrame(ONE, SCHEMA))).first().asDict()
    assert len(MODEL_FEATURES) == 29 and list(row) == list(MODEL_FEATURES)
    assert all(v is not None for v in row.values())
    assert row["route"] == "JFK_LAX" and row["carrier_origin"] == "AA_JFK"
    assert (row["departure_hour"], row["departure_minute"], row["departure_time_minutes"]) == (8, 30, 510)
    assert (row["year"], row["month"], row["quarter"], row["day"]) == (2026, 9, 3, 1)
    assert (row["day_of_week"], row["is_weekend"], row["week_of_year"]) == (1, 0, 36)
    assert row["departure_period"] == "morning" and row["is_peak_departure"] == 1
    assert row["distance_log"] == pytest.approx(math.log1p(2475))
    assert row["departure_hour_sin"] == pytest.approx(math.sin(2 * math.pi * 8 / 24))


def test_departure_and_edges(spark):
    base = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], ONE[0]))
    rows = [
        {**base, "CRS_DEP_TIME": 2359, "CRS_ARR_TIME": 2400},
        {**base, "CRS_DEP_TIME": 600, "FL_DATE": "12/30/2024 12:00:00 AM"},
        {**base, "CRS_DEP_TIME": 601, "ORIGIN": None},
        {**base, "CRS_DEP_TIME": 0, "FL_DATE": "2027-01-01"},
    ]
    df = spark.createDataFrame([tuple(r[k] for k in base) for r in rows], SCHEMA)
    got = with_features(df).collect()
    assert got[0]["scheduled_departure"] == datetime(2026, 9, 1, 23, 59)
    assert got[0]["arrival_hour"] == 24 and got[0]["departure_period"] == "evening"
    assert got[1]["week_of_year"] == 1 and got[1]["departure_period"] == "night"
    assert got[2]["route"] is None and got[2]["departure_period"] == "night"
    assert got[3]["week_of_year"] == 53


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame(ONE, SCHEMA).drop("ORIGIN", "DEST")
    with pytest.raises(InputError, match="Missing required columns: DEST, ORIGIN"):
        with_features(df)


def test_text_and_typed_trips_give_the_same_features(spark):
    text = text_frame(spark, text_rows(12))
    typed = text.select(
        F.to_date("FL_DATE").alias("FL_DATE"),
        "OP_UNIQUE_CARRIER",
        "ORIGIN",
        "DEST",
        *(F.col(c).cast("int").alias(c) for c in ("CRS_DEP_TIME", "CRS_ARR_TIME")),
        *(F.col(c).cast("double").alias(c) for c in ("CRS_ELAPSED_TIME", "DISTANCE")),
    )
    names = [c for c in MODEL_FEATURES if c not in ("CRS_ELAPSED_TIME", "DISTANCE")]
    a = [tuple(r) for r in with_features(text).select(*names).collect()]
    b = [tuple(r) for r in with_features(typed).select(*names).collect()]
    assert a == b


def test_dates(spark):
    cases = {
        "2026-09-01": date(2026, 9, 1),
        "9/1/2026 12:00:00 AM": date(2026, 9, 1),
        "9/1/2026 11:30:00 PM": date(2026, 9, 1),
        "2026-09-01T10:00:00": date(2026, 9, 1),
        "2026-09-01 10:00:00.123": date(2026, 9, 1),
        "2026-9-1 7:05": date(2026, 9, 1),
        "2026-09-01 25:00:00": None,
        "9/1/2026 13:00:00 PM": None,
        "9/1/2026": date(2026, 9, 1),
        "13/1/2026": None,
        " 2026/9/1 ": date(2026, 9, 1),
        "20260901": date(2026, 9, 1),
        "2026-02-30": None,
        "12:30": None,
        "2026": None,
        "": None,
        "not-a-date": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["d"] for r in df.select("s", parse_date(F.col("s")).alias("d")).collect()} == cases


def test_clock_text(spark):
    cases = {"630": "06:30", "0630": "06:30", "0": "00:00", "2359": "23:59", "2400": None, "1260": None, "x": None, "8.5": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", parse_hhmm(F.col("s")).alias("t")).collect()} == cases


def test_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(round_half_even(F.col("x"))).collect()] == [2.68, 0.12, 1.0, -0.12]


def test_impute(spark):
    df = spark.createDataFrame([(None, None)], "DISTANCE double, note string")
    assert tuple(impute_zero(df).first()) == (0.0, None)


def test_folds_do_not_depend_on_partitioning(spark):
    df = spark.range(2_000)
    a = {tuple(r) for r in df.repartition(7).select("id", fold_of(["id"], 5)).collect()}
    b = {tuple(r) for r in df.coalesce(1).select("id", fold_of(["id"], 5)).collect()}
    assert a == b
    sizes = [r["count"] for r in df.select(fold_of(["id"], 5).alias("f")).groupBy("f").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 300
    with pytest.raises(ValueError):
        fold_of(["id"], 1)


def test_whole_numbers_are_read_like_any_decimal_text(spark):
    from latewing.functions.numbers import _DECIMAL_TEXT, decimal_number

    texts = ["0630", "007", "9007199254740993", "99999999999999999999", "-5", "+5", " 5", "5 ", "5\x00", "\x005", "1d", "0x1F",
             "5.", ".5", "1e3", "1_0", "٥", "5٥", "5\n", "", "0", "-0", "9" * 400, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shape = F.regexp_extract("t", _DECIMAL_TEXT, 0).try_cast("double")
    for row in df.select("t", decimal_number(F.col("t")).alias("got"), shape.alias("wanted")).collect():
        assert row["got"] == row["wanted"], row
