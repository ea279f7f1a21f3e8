"""A stored row for every micro-batch: what came in, what became of it, and what was too late."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.published import _Files

#: Name under which a stream observes its counts; see ``jobs.start_scoring``.
COUNTS = "rows"
_ROW = """query string, batch bigint, triggered_at string, watermark string, rows_in bigint, scored bigint,
quarantined bigint, late bigint, repeated bigint, rows_per_second double, milliseconds bigint"""


def progress_row(progress) -> dict:
    """One micro-batch; late rows and repeats are what stateful steps dropped."""
    seen = progress.observedMetrics.get(COUNTS)
    counts = seen.asDict() if seen is not None else {}
    return {
        "query": str(progress.id),
        "batch": progress.batchId,
        "triggered_at": progress.timestamp,
        "watermark": progress.eventTime.get("watermark"),
        "rows_in": progress.numInputRows,
        "scored": counts.get("scored", 0),
        "quarantined": counts.get("quarantined", 0),
        "late": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators),
        "repeated": sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in progress.stateOperators),
        "rows_per_second": progress.processedRowsPerSecond,
        "milliseconds": progress.batchDuration,
    }


class ProgressLog(StreamingQueryListener):
    """Writes one small file for each micro-batch of the session's streams under ``folder``.

    A file is named by the stream, which keeps its identity when it is started again from its
    checkpoint, and by the batch: a replayed batch replaces its row. ``with`` adds and removes it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.files, self.ended = _Files(spark, folder), {}

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _end(self, run) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = progress_row(event.progress)
        self.files.replace(f"{self.folder}/{row['query']}/{row['batch']:012d}.json", json.dumps(row))

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def finish(self, stream: StreamingQuery, seconds: float = 600) -> None:
        """Waits for a stream that ends on its own, and until its last row is written."""
        stream.awaitTermination()
        if not self._end(stream.runId).wait(seconds):
            raise TimeoutError("the stream's last progress did not arrive")


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all micro-batches that brought rows."""
    return spark.read.schema(_ROW).json(f"{folder}/*").where(F.col("rows_in") > 0)
