import glob
import json
import time

import pytest
from helpers import DistanceModel, text_frame, text_rows

from latewing.operators import rollups as R
from latewing.operators.scoring import score_text
from latewing.schema import PREDICTION, REQUIRED_COLUMNS
from latewing.session import free_shuffles
from latewing.sources.published import published
from latewing.streaming import jobs
from pyspark.sql import functions as F


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({k: r[k] for k in REQUIRED_COLUMNS}) for r in rows) + "\n")


def test_stream_scores_like_batch_and_replays_cleanly(spark, tmp_path):
    rows = text_rows(30)
    rows[4]["DISTANCE"] = "abc"
    rows[9]["FL_DATE"] = ""
    for i in range(3):
        drop(tmp_path / "in", f"{i}.json", rows[i * 10 : i * 10 + 10])
    out = str(tmp_path / "out")

    def run():
        stream = jobs.record_stream(spark, str(tmp_path / "in"), files_per_batch=1)
        query = jobs.start_scoring(stream, DistanceModel, out, str(tmp_path / "state"), availableNow=True)
        query.awaitTermination(300)
        assert query.exception() is None

    run()
    run()
    key = ["FL_DATE", "CRS_DEP_TIME", "DISTANCE", PREDICTION]
    scored = published(spark, out, "scored")
    assert scored.select("batch_id").distinct().count() == 3
    good = [r for i, r in enumerate(rows) if i not in (4, 9)]
    batch = score_text(text_frame(spark, good), DistanceModel)
    assert sorted(tuple(r) for r in scored.select(*key).collect()) == sorted(tuple(r) for r in batch.select(*key).collect())
    bad = published(spark, out, "quarantine")
    assert sorted(r["broken_rules"] for r in bad.collect()) == ["DISTANCE_numeric", "FL_DATE_date"]


def run_to_memory(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


@pytest.fixture(scope="module")
def events(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartitionByRange(4, "ts").write.mode("overwrite").parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return batch, stream


def same(a, b):
    return sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_rates_on_a_stream_equal_batch(spark, events):
    batch, stream = events
    got = run_to_memory(spark, R.request_rate(jobs.watermarked(stream), by=["event_type"]), "rates", "complete")
    assert same(got, R.request_rate(batch, by=["event_type"]))


def test_error_share_and_latest_state_on_a_stream(spark, events):
    batch, stream = events
    assert same(run_to_memory(spark, R.error_share(stream), "shares", "complete"), R.error_share(batch))
    assert same(run_to_memory(spark, R.latest_state(stream), "states", "complete"), R.latest_state(batch))


def test_append_mode_emits_closed_windows_only(spark, events):
    batch, stream = events
    got = run_to_memory(spark, R.request_rate(jobs.watermarked(stream, "1 hour")), "closed", "append").collect()
    everything = {tuple(r) for r in R.request_rate(batch).collect()}
    assert 0 < len(got) < len(everything)


def test_approximate_percentile_is_close(events):
    batch, _ = events
    exact = {r["window_start"]: r["percentile"] for r in R.percentile_by_window(batch, width="1 day").collect()}
    for r in R.approx_percentile_by_window(batch, width="1 day").collect():
        assert r["percentile"] == pytest.approx(exact[r["window_start"]], rel=0.25)


def test_daily_delay_on_a_stream(spark, events):
    batch, stream = events
    rename = {"ts": "FL_DATE", "value": PREDICTION}
    got = run_to_memory(spark, jobs.daily_delay(stream.withColumnsRenamed(rename)), "days", "complete")
    expected = batch.groupBy(F.to_date("ts").alias("date")).agg(F.avg("value"), F.count("value"))
    assert {r[0]: (pytest.approx(r[1]), r[2]) for r in got.collect()} == {r[0]: (r[1], r[2]) for r in expected.collect()}


def test_repeats_are_dropped(spark, events):
    batch, stream = events
    twice = stream.unionByName(stream)
    got = run_to_memory(spark, jobs.without_repeats(twice, "60 days").select("event_id"), "once", "append")
    assert got.count() == batch.count()


def test_a_micro_batch_is_read_once_and_bad_rows_reach_no_model(spark, tmp_path, monkeypatch):
    class PickyModel:
        """Refuses what no good row holds."""

        def predict(self, frame):
            assert str(frame["month"].dtype) == "int32" and list(frame.index) == list(range(len(frame)))
            assert (frame["DISTANCE"] >= 500).all() and not (frame["ORIGIN"].str.strip() == "").any()
            return frame["DISTANCE"] / 100

    rows = text_rows(40)
    for i, change in enumerate(
        ({"FL_DATE": None}, {"DISTANCE": "-10"}, {"ORIGIN": "  "}, {"CRS_DEP_TIME": "2575"}, {"CRS_ARR_TIME": "1d"})
    ):
        rows[i * 7].update(change)
    drop(tmp_path / "in", "0.json", rows)
    drop(tmp_path / "in", "1.json", [rows[0]])  # a batch of broken rows only
    read = spark.sparkContext.accumulator(0)

    def counted(value):
        read.add(1)
        return value

    stream = jobs.record_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    once = F.udf(counted, "string").asNondeterministic()
    stream = stream.withColumn("CRS_ELAPSED_TIME", once("CRS_ELAPSED_TIME"))
    out = str(tmp_path / "out")

    def kept(*_):
        raise AssertionError("a micro-batch need not be kept")

    monkeypatch.setattr(type(stream), "persist", kept)
    query = jobs.start_scoring(stream, PickyModel, out, str(tmp_path / "state"), availableNow=True)
    query.awaitTermination(300)
    assert query.exception() is None and read.value == 41
    scored, bad = published(spark, out, "scored"), published(spark, out, "quarantine")
    assert scored.columns == [*REQUIRED_COLUMNS, PREDICTION, "batch_id"] and scored.count() == 35
    assert bad.columns == [*REQUIRED_COLUMNS, "broken_rules", "batch_id"]
    expected = ["CRS_ARR_TIME_numeric", "CRS_DEP_TIME_clock", "DISTANCE_negative", "FL_DATE_date", "FL_DATE_date", "ORIGIN_blank"]
    assert sorted(r["broken_rules"] for r in bad.collect()) == expected


def test_a_stream_scored_by_a_fitted_model(spark, tmp_path):
    from pyspark.ml.regression import LinearRegression

    from latewing.operators import modeling

    rows = text_rows(20)
    rows[3]["CRS_DEP_TIME"] = "oops"
    drop(tmp_path / "in", "0.json", rows)
    known = spark.createDataFrame([(float(i * 10), float(i)) for i in range(90)], "DISTANCE double, ARR_DELAY double")
    line = LinearRegression(featuresCol=modeling.FEATURES, labelCol="ARR_DELAY", predictionCol=modeling.RAW_PREDICTION)
    model = modeling.DelayModel(modeling.fit(known, modeling.encoded_preprocessor(["DISTANCE"]), line))
    out = str(tmp_path / "out")
    stream = jobs.record_stream(spark, str(tmp_path / "in"))
    jobs.start_scoring(stream, model, out, str(tmp_path / "state"), availableNow=True).awaitTermination(300)
    got = {r["DISTANCE"]: r[PREDICTION] for r in published(spark, out, "scored").collect()}
    assert got == {r["DISTANCE"]: pytest.approx(float(r["DISTANCE"]) / 10, abs=0.011) for i, r in enumerate(rows) if i != 3}
    assert [r["broken_rules"] for r in published(spark, out, "quarantine").collect()] == ["CRS_DEP_TIME_numeric"]


def _tables(spark, folder, orders=400):
    """A few hundred records of the five tables that trips are made of."""
    day = F.date_add(F.lit("1994-01-01").cast("date"), (F.col("id") * 7 % 2000).cast("int"))
    records = spark.range(orders).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 90).alias("l_partkey"),
        (F.col("id") % 10).alias("l_suppkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), day.alias("l_shipdate"),
    )
    frames = {
        "lineitem": records,
        "orders": spark.range(orders).select(F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey")),
        "customer": spark.range(20).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).alias("c_nationkey")),
        "supplier": spark.range(10).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("s_nationkey")),
        "nation": spark.createDataFrame([(0, "PERU"), (1, "CHINA"), (2, "KENYA")], "n_nationkey bigint, n_name string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_the_progress_query_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """Deliveries are packed and go when they were taken in, shuffles are freed, and the keys are not on the heap."""
    from latewing.catalog import streams

    folder, folders, arrived, kept = _tables(spark, tmp_path / "tables"), {}, [], []
    make, start = streams.new_folder, jobs.start_scoring
    monkeypatch.setattr(streams, "new_folder", lambda spark, name: folders.setdefault(name, make(spark, name)))

    def started(records, *rest, **more):
        files = glob.glob(f"{folders['arriving'].removeprefix('file:')}/part-*")
        arrived.append(files)
        assert files and all(f.endswith(".json.gz") for f in files)
        kept.append(spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""))
        return start(records, *rest, **more)

    monkeypatch.setattr(jobs, "start_scoring", started)
    rows = {r["part"]: r.asDict() for r in streams.stream_progress(spark, folder).collect()}
    assert len(arrived) == 2 and not {*arrived[0]} & {*arrived[1]}
    assert not glob.glob(f"{folders['arriving'].removeprefix('file:')}/part-*")
    assert all("RocksDB" in name for name in kept)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    # Of 400 orders 320 come first; then the other 80, and 16 of the first again.
    assert rows[1]["rows_in"] == rows[1]["scored"] + rows[1]["quarantined"] == 320 and rows[1]["quarantined"] > 0
    assert rows[2]["rows_in"] == 96 and rows[2]["late"] > 0 and rows[2]["repeated"] > 0
    assert all(r["all_told"] for r in rows.values())


def test_shuffles_of_finished_jobs_are_freed(spark):
    tracked = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()

    def shuffles():
        return set(filter(None, tracked.keys().mkString(",").split(",")))

    before = shuffles()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    made = shuffles() - before
    assert made
    for _ in range(20):
        free_shuffles(spark)
        if not made & shuffles():
            return
        time.sleep(0.5)
    raise AssertionError("the shuffle is still there")
