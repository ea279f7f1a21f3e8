"""Continuous scoring and continuous rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality as Q
from ..operators.scoring import score_text
from ..plans.batch_scoring import with_reasons
from ..schema import DATE, PREDICTION, REQUIRED_COLUMNS
from ..sources.published import Divided, publish
from .progress import COUNTS


def record_stream(
    spark: SparkSession, folder: str, columns=REQUIRED_COLUMNS, files_per_batch: int = 100
) -> DataFrame:
    """JSON records arriving as files, all fields as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def start_scoring(records: DataFrame, model, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score a stream through the batch path; bad rows go to a quarantine table.

    Every micro-batch is a published run of both tables (``sources.published``), so a replayed
    batch leaves no duplicates. Both counts are observed; ``progress.ProgressLog`` keeps
    them with the rows that came too late. Give a trigger such as ``availableNow=True``.
    """
    broken = F.size(Q.BROKEN) > 0
    marked = Q.flagged(records, Q.scoring_rules()).observe(
        COUNTS, F.count_if(~broken).alias("scored"), F.count_if(broken).alias("quarantined")
    )

    text = list(records.columns)

    def handle(batch: DataFrame, number: int) -> None:
        # One pass over the micro-batch writes both tables, so nothing of it is kept in between.
        whole = with_reasons(score_text(batch, model, fit=F.size(Q.BROKEN) == 0))
        place = F.when(F.col(Q.BROKEN) == "", "scored").otherwise("quarantine")
        tables = {"scored": [*text, PREDICTION], "quarantine": [*text, Q.BROKEN]}
        publish(folder, Divided(whole, place, tables), f"{number:012d}", "batch_id")

    return (
        marked.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def daily_delay(scored: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Mean and count per day of a scored stream with a timestamp in ``FL_DATE``.

    In append mode a day appears once the watermark has passed its end.
    """
    return (
        scored.withWatermark(DATE, lateness)
        .groupBy(F.window(DATE, "1 day").alias("w"))
        .agg(F.avg(PREDICTION).alias("avg_predicted_delay"), F.count(PREDICTION).alias("flights"))
        .select(F.col("w.start").cast("date").alias("date"), "avg_predicted_delay", "flights")
    )


def watermarked(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Event stream ready for the rollups: state of closed windows is dropped."""
    return events.withWatermark("ts", lateness)


def without_repeats(
    events: DataFrame, lateness: str = "10 minutes", time: str = "ts", key: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Each event once, although its source may deliver it again within the lateness; later ones are dropped."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key))
