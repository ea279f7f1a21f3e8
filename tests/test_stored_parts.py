"""Panes, the cube, monthly copies and monthly profiles: parts that are kept and merged."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from latewing.operators import analysis as A
from latewing.operators import cube
from latewing.operators import panes as P
from latewing.operators import profile
from latewing.operators import rollups as R
from latewing.schema import PREDICTION
from latewing.sources import files
from latewing.sources.trips import raw_facts, table, trip_facts, trips


def spark_mode(df):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")


def explained(df):
    return df._jdf.queryExecution().explainString(spark_mode(df))


@pytest.fixture(scope="module")
def events(spark, medium):
    return table(spark, medium, "events")


def test_sliding_rate_copies_no_event(events):
    from_panes = R.request_rate(events, "1 hour", "15 minutes", by=["event_type"])
    copied = events.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert "Expand" not in explained(from_panes) and "Expand" in explained(copied)
    rows = lambda df, names: sorted(tuple(r[n] for n in names) for r in df.collect())
    want = rows(copied.select("w.start", "event_type", "n"), ("start", "event_type", "n"))
    assert rows(from_panes, ("window_start", "event_type", "requests")) == want
    # Only panes, after their aggregate, are exploded.
    text = explained(from_panes)
    assert text.index("HashAggregate") < text.index("Generate")


def test_windows_need_whole_panes(events):
    panes = P.pane_partials(events, "15 minutes")
    with pytest.raises(ValueError, match="whole panes"):
        P.windows_over(panes, "40 minutes", "15 minutes")
    uneven = R.request_rate(events, "40 minutes", "15 minutes")  # falls back to copies
    assert uneven.agg(F.sum("requests")).first()[0] >= events.count() * 2


def test_sketched_quantiles_stay_within_their_error(spark):
    values = spark.range(200_000).select(
        F.timestamp_seconds(F.col("id") % 7200).alias("ts"), (F.xxhash64("id") % 1_000_003).cast("double").alias("value")
    )
    panes = P.pane_partials(values, "15 minutes", value="value")
    merged = P.sliding_quantiles(panes, {"p95": 0.95, "p50": 0.5}, "1 hour", "15 minutes")
    off = P.within_error(values, merged, "p95", 0.95, "1 hour", "15 minutes").collect()
    off += P.within_error(values, merged, "p50", 0.5, "1 hour", "15 minutes").collect()
    assert len(off) == 22 and all(r["within_error"] for r in off) and max(r["rows"] for r in off) > 99_000


def test_cube_answers_filters_without_the_records(spark, small, tmp_path):
    scored, folder = trips(spark, small), str(tmp_path / "cube")
    cube.store_cube(scored, folder)
    chosen = A.Filters(carriers=("C1", "C2"), date_range=(date(1996, 3, 5), date(1998, 2, 1)))
    read = cube.read_cube(spark, folder, chosen)
    text = explained(cube.cube_kpis(read))
    assert "PartitionFilters: [isnotnull(cube_month" in text and "lineitem" not in text and "cube" in text
    for filters in (chosen, None, A.Filters(origins=("nowhere",))):
        want = A.apply_filters(A.with_day(scored), filters)
        found = cube.read_cube(spark, folder, filters)
        assert [tuple(r) for r in cube.cube_kpis(found).collect()] == [pytest.approx(tuple(r), nan_ok=True) for r in A.kpis(want).collect()]
        by = lambda df: {tuple(r[:2]): (r[2], r[3]) for r in A.ranked_groups(df, {"ORIGIN": "o", "DEST": "d"}).collect()}
        ours, theirs = by(cube.cube_sums(found)), by(want)
        assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k]) for k in ours)


def test_a_month_of_the_cube_is_replaced_alone(spark, small, tmp_path):
    scored, folder = trips(spark, small), tmp_path / "cube"
    cube.store_cube(scored, str(folder))
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    march = scored.where(F.date_format("FL_DATE", "yyyy-MM") == "1996-03")
    cube.store_cube(march.withColumn(PREDICTION, F.col(PREDICTION) + 1000), str(folder))
    after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert changed == {"cube_month=1996-03"} and all(after[p] == before[p] for p in before.keys() & after.keys())
    assert cube.read_cube(spark, str(folder)).agg(F.sum("rows")).first()[0] == scored.count()


def test_missing_values_of_the_cube(spark, tmp_path):
    rows = [(date(2026, 1, 1), "A", "X", "Y", 1.0), (None, "A", None, "Y", 2.0), (date(2026, 1, 1), "A", "X", "Y", None),
            (date(2026, 1, 1), "A", "X", "Y", float("nan"))]
    df = spark.createDataFrame(rows, f"FL_DATE date, OP_UNIQUE_CARRIER string, ORIGIN string, DEST string, {PREDICTION} double")
    cube.store_cube(df, str(tmp_path / "c"))
    found = cube.read_cube(spark, str(tmp_path / "c"))
    assert found.agg(F.sum("rows")).first()[0] == 4 and cube.cube_kpis(found).first()["total_flights"] == 2


def test_monthly_store(spark, small, tmp_path):
    folder, records = tmp_path / "months", raw_facts(spark, small).where("MONTH IN (1, 2, 3) AND YEAR = 1996")
    files.store_by_month(records, str(folder))
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    assert len(before) == 3  # a small month is one file
    files.store_by_month(records.where("MONTH = 2").limit(5), str(folder))
    after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    assert {p.parent.name for p in before.keys() ^ after.keys()} == {"MONTH=2"}
    stored = spark.read.parquet(str(folder))
    assert stored.where("MONTH = 2").count() == 5
    assert stored.where("MONTH <> 2").count() == records.where("MONTH <> 2").count()
    assert "PartitionFilters: [isnotnull(MONTH" in explained(stored.where("MONTH = 1").select("DISTANCE"))


def test_a_large_month_is_cut_by_size(spark, tmp_path):
    big = spark.range(400_000).select(F.lit(2026).alias("YEAR"), F.lit(1).alias("MONTH"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        files.store_by_month(big.repartition(8), str(tmp_path / "m"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    sizes = [p.stat().st_size for p in (tmp_path / "m").rglob("*.parquet")]
    assert 3 <= len(sizes) <= 16 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_profiles_merge(spark, medium, tmp_path):
    columns, folder = ["l_orderkey", "l_partkey", "OP_UNIQUE_CARRIER", "ARR_DELAY"], str(tmp_path / "p")
    facts = trip_facts(spark, medium)
    odd = F.col("l_orderkey") % 2 == 1
    profile.store_profile(facts.where(odd).select(*columns), folder, "2026-01")
    profile.store_profile(facts.where(~odd).select(*columns), folder, "2026-02")
    profile.store_profile(facts.where(~odd).select(*columns), folder, "2026-02")  # again: replaced
    merged = {r["column"]: r for r in profile.merged_profile(spark, folder).collect()}
    exact = {r["column"]: r for r in profile.column_profile(facts, columns).collect()}
    assert all(merged[c]["rows"] == facts.count() and merged[c]["nulls"] == exact[c]["nulls"] for c in columns)
    for c in columns:
        assert merged[c]["distinct_values"] == pytest.approx(exact[c]["distinct_values"], rel=4 * profile.HLL_ERROR)
    text = explained(profile.merged_profile(spark, folder))
    assert "lineitem" not in text and "month=" not in text.split("ReadSchema")[-1]
