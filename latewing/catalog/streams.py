"""Queries that run as streams over records arriving as files, until none are left."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window, functions as F

from ..schema import DATE, PREDICTION, REQUIRED_COLUMNS
from ..session import free_shuffles, new_folder
from ..sources.published import _Files, publish, published
from ..sources.trips import table, text_trips, trip_facts, trips
from ..streaming import jobs
from ..streaming.progress import ProgressLog, read_progress
from ..streaming.stuck import MANY_KEYS, keyed_state, stuck_keys
from .learning import _GOOD, DistanceModel
from .registry import FACTS, TEXT, query


def _finished(stream) -> None:
    """Waits for a stream that ends on its own; raises what made it fail."""
    stream.awaitTermination()


@query(
    "stream_scored",
    f"""WITH {TEXT}, scored AS (SELECT ORIGIN, DEST, round_even(TRY_CAST(DISTANCE AS DOUBLE) / 100, 2) AS p, ({_GOOD}) AS good
 FROM text)
SELECT ORIGIN, DEST, count(*) FILTER (good) AS scored, count(*) FILTER (NOT good) AS quarantined,
round(sum(p) FILTER (good), 6) AS predicted FROM scored GROUP BY ALL""",
)
def stream_scored(spark, folder):
    """Text records through the scoring stream; both of its tables, read back and counted."""
    arriving, out, state = (new_folder(spark, name) for name in ("arriving", "stream", "state"))
    text_trips(trips(spark, folder)).select(*REQUIRED_COLUMNS).write.json(arriving)
    records = jobs.record_stream(spark, arriving)
    _finished(jobs.start_scoring(records, DistanceModel, out, state, availableNow=True))
    scored = published(spark, out, "scored").select("ORIGIN", "DEST", PREDICTION, F.lit(True).alias("good"))
    bad = published(spark, out, "quarantine").select(
        "ORIGIN", "DEST", F.lit(None).cast("double").alias(PREDICTION), F.lit(False).alias("good")
    )
    return scored.unionByName(bad).groupBy("ORIGIN", "DEST").agg(
        F.count_if("good").alias("scored"),
        F.count_if(~F.col("good")).alias("quarantined"),
        F.round(F.sum(PREDICTION), 6).alias("predicted"),
    )


@query(
    "stream_daily",
    f"""WITH {FACTS}, last AS (SELECT max(FL_DATE) AS day FROM facts)
SELECT strftime(FL_DATE, '%Y-%m-%d') AS date, round(avg(predicted_arr_delay), 6) AS avg_predicted_delay,
count(predicted_arr_delay) AS flights FROM facts, last WHERE FL_DATE <= last.day - INTERVAL 2 DAY GROUP BY 1""",
)
def stream_daily(spark, folder):
    """Days in append mode: those whose end the watermark, a day behind the last record, has passed."""
    arriving, out, state = (new_folder(spark, name) for name in ("arriving", "stream", "state"))
    facts = trip_facts(spark, folder).select(F.col(DATE).cast("timestamp").alias(DATE), PREDICTION)
    facts.write.parquet(arriving)
    days = jobs.daily_delay(spark.readStream.schema(facts.schema).parquet(arriving))
    _finished(
        days.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    )
    return spark.read.schema(days.schema).parquet(out)


_PATIENCE, _LATENESS = timedelta(hours=48), timedelta(minutes=10)


@query(
    "stream_unfinished",
    """WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following,
 date_trunc('milliseconds', max(ts) OVER ()) - INTERVAL 10 MINUTE AS watermark FROM events)
SELECT user_id, event_type AS state, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
 strftime(ts + INTERVAL 48 HOUR, '%Y-%m-%d %H:%M:%S') AS stuck_at FROM e
WHERE event_type IN ('signup', 'view') AND ts + INTERVAL 48 HOUR <= watermark
 AND (following IS NULL OR following > ts + INTERVAL 48 HOUR)""",
)
def stream_unfinished(spark, folder):
    """Users whom an open state held for two days without another event, from a stream with keyed state and timers."""
    arriving, out, state = (new_folder(spark, name) for name in ("arriving", "stuck", "state"))
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp"))
    events.write.parquet(arriving)
    # All files in one batch: they are not in the order of time, and what a batch finds too old is dropped.
    stream = spark.readStream.schema(events.schema).parquet(arriving)
    lateness = f"{_LATENESS // timedelta(minutes=1)} minutes"
    with keyed_state(spark):
        stuck = stuck_keys(stream, ["signup", "view"], _PATIENCE, lateness)
        writer = stuck.writeStream.format("parquet").option("checkpointLocation", state)
        _finished(writer.trigger(availableNow=True).start(out))
    return spark.read.schema(stuck.schema).parquet(out)


_RECORD = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "file_order")


@query(
    "stream_progress",
    f"""WITH {TEXT}, marked AS (SELECT {', '.join(_RECORD)}, ({_GOOD}) AS good FROM text),
numbered AS (SELECT m.l_orderkey, m.good, t.FL_DATE AS arrived FROM marked m JOIN trips t ON m.l_orderkey = t.l_orderkey
 AND m.l_linenumber = t.l_linenumber AND m.l_partkey = t.l_partkey AND m.l_suppkey = t.l_suppkey AND m.file_order = t.DISTANCE),
first AS (SELECT * FROM numbered WHERE l_orderkey % 5 <> 0), line AS (SELECT max(arrived) - INTERVAL 365 DAY AS w FROM first),
second AS (SELECT numbered.*, FALSE AS again FROM numbered WHERE l_orderkey % 5 = 0
 UNION ALL SELECT numbered.*, TRUE FROM numbered WHERE l_orderkey % 25 = 1)
SELECT CAST(1 AS BIGINT) AS part, count(*) AS rows_in, count(*) FILTER (good) AS scored,
 count(*) FILTER (NOT good) AS quarantined, CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS repeated, TRUE AS all_told FROM first
UNION ALL SELECT 2, count(*), count(*) FILTER (good AND NOT again AND arrived > w),
 count(*) FILTER (NOT good AND NOT again AND arrived > w), count(*) FILTER (arrived <= w),
 count(*) FILTER (again AND arrived > w), TRUE FROM second, line""",
)
def stream_progress(spark, folder):
    """Two deliveries through the scoring stream; in the second many records are a year late, and some came before.

    The rows are what the progress log kept: all that came in was scored, quarantined or dropped.
    """
    arriving, out, state, log = (new_folder(spark, n) for n in ("arriving", "stream", "state", "progress"))
    order = F.col("l_orderkey")
    dated = trips(spark, folder).withColumn("arrived", F.col("FL_DATE").cast("timestamp"))
    records = text_trips(dated, also=["arrived"]).select(
        *REQUIRED_COLUMNS, "arrived", F.concat_ws("-", *_RECORD).alias("record"), "l_orderkey"
    )
    deliveries = [records.where(order % 5 != 0), records.where((order % 5 == 0) | (order % 25 == 1))]
    # As plain text a delivery is 15 times as large as the tables. Packed files cannot be split, so none may be large.
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 500_000}
    with ProgressLog(spark, log) as progress, keyed_state(spark, MANY_KEYS):
        for rows in deliveries:
            rows.drop("l_orderkey").write.mode("append").options(**packed).json(arriving)
            free_shuffles(spark)
            schema = rows.drop("l_orderkey").schema
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100_000).json(arriving)
            once = jobs.without_repeats(stream, "365 days", "arrived", ["record"]).select(*REQUIRED_COLUMNS)
            progress.finish(jobs.start_scoring(once, DistanceModel, out, state, availableNow=True))
            # A delivery that was taken in whole is not read again.
            _Files(spark, arriving).delete(arriving)
            free_shuffles(spark)
    found = read_progress(spark, log)
    told = F.col("scored") + F.col("quarantined") + F.col("late") + F.col("repeated") == F.col("rows_in")
    part = F.row_number().over(Window.partitionBy("query").orderBy("batch"))  # one row for each micro-batch
    return found.select(
        part.alias("part"), "rows_in", "scored", "quarantined", "late", "repeated", told.alias("all_told")
    )


@query(
    "publish_read_back",
    f"""WITH {FACTS} SELECT concat('month-', month(FL_DATE)) AS run_id, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum,
 round(sum(predicted_arr_delay), 6) AS predicted FROM facts WHERE month(FL_DATE) <= 2 GROUP BY 1""",
)
def publish_read_back(spark, folder):
    """Two runs, one of them published twice, first with other rows: readers see the last of each, whole."""
    root, facts = new_folder(spark, "published"), trip_facts(spark, folder)
    month = F.month("FL_DATE")
    publish(root, {"scored": facts.where(month == 7)}, "month-1")
    for number in (1, 2):
        publish(root, {"scored": facts.where(month == number)}, f"month-{number}")
    return published(spark, root, "scored").groupBy("run_id").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"), F.sum(PREDICTION).alias("predicted")
    )
