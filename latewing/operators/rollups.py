"""Windowed rollups of operational events (batch; most also run on a stream).

An event has ``event_id, ts, user_id, event_type, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import DURATION_BOUNDS
from .distribution import distribution
from .panes import pane_partials, seconds_of, sliding_rate


def _window(width: str, slide: str | None) -> Column:
    return F.window("ts", width, slide) if slide else F.window("ts", width)


def request_rate(
    events: DataFrame, width: str = "1 hour", slide: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Events and events per second in each window, optionally per key.

    Overlapping windows of a table are merged from panes, so no event is copied.
    """
    if slide and not events.isStreaming and seconds_of(width) % seconds_of(slide) == 0:
        return sliding_rate(pane_partials(events, slide, by), width, slide, by).select(
            "window_start", *by, "requests", "per_second"
        )
    return (
        events.groupBy(_window(width, slide).alias("w"), *by)
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").alias("window_start"),
            *by,
            "requests",
            (F.col("requests") / seconds_of(width)).alias("per_second"),
        )
    )


def error_share(events: DataFrame, width: str = "1 hour", error_type: str = "error") -> DataFrame:
    """Percent of error events in each window."""
    errors, total = F.count_if(F.col("event_type") == error_type), F.count("*")
    return (
        events.groupBy(F.window("ts", width).alias("w"))
        .agg(errors.alias("errors"), total.alias("requests"))
        .select(
            F.col("w.start").alias("window_start"),
            "errors",
            "requests",
            (100 * F.col("errors") / F.greatest("requests", F.lit(1))).alias("error_percent"),
        )
    )


def percentile_by_window(
    events: DataFrame, share: float = 0.95, width: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Exact percentile of ``value`` per window (batch)."""
    placed = events.select(_window(width, slide).getField("start").alias("window_start"), "value")
    return distribution(placed, "value", {"percentile": share}, ["window_start"]).select(
        "window_start", "rows", "percentile"
    )


def approx_percentile_by_window(
    events: DataFrame, share: float = 0.95, width: str = "1 hour", slide: str | None = None, accuracy: int = 10_000
) -> DataFrame:
    """Approximate percentile per window; state of bounded size, so it also runs on a stream."""
    return (
        events.groupBy(_window(width, slide).alias("w"))
        .agg(F.count("value").alias("rows"), F.percentile_approx("value", share, accuracy).alias("percentile"))
        .select(F.col("w.start").alias("window_start"), "rows", "percentile")
    )


def duration_buckets(events: DataFrame, bounds: Sequence[float] = DURATION_BOUNDS, value: str = "value") -> DataFrame:
    """Cumulative histogram: (position, le, rows) with an open last bucket, from one aggregate."""
    counted = events.agg(
        *(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)),
        F.count(value).alias(f"b{len(bounds)}"),
    )
    labels = [*(str(b) for b in bounds), "+Inf"]
    rows = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(le).alias("le"), F.col(f"b{i}").alias("rows"))
        for i, le in enumerate(labels)
    ]
    return counted.select(F.inline(F.array(*rows))).orderBy("position")


def state_counts(events: DataFrame) -> DataFrame:
    """Per state: number of events, total value and the newest time."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("events"), F.sum("value").alias("value_sum"), F.max("ts").alias("last_seen")
    )


def job_counters(events: DataFrame, started: str, succeeded: str, failed: str) -> DataFrame:
    """One row: jobs started, succeeded, failed and the amount handled by the succeeded ones."""

    def of(state: str) -> Column:
        return F.col("event_type") == state

    return events.agg(
        F.count_if(of(started)).alias("started"),
        F.count_if(of(succeeded)).alias("succeeded"),
        F.count_if(of(failed)).alias("failed"),
        F.sum(F.when(of(succeeded), F.col("value"))).alias("handled"),
    )


def latest_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Newest event per key; ties of time go to the larger id.

    Each task sorts its rows by key and sends one per key: a text state leaves Spark no hash aggregate.
    """
    order = F.struct("ts", "event_id")
    return events.groupBy(key).agg(
        F.max_by("event_type", order).alias("state"),
        F.max_by("event_id", order).alias("event_id"),
        F.max("ts").alias("ts"),
    )


def unfinished(events: DataFrame, open_states: Sequence[str], key: str = "user_id") -> DataFrame:
    """Keys whose newest state is still open."""
    return latest_state(events, key).where(F.col("state").isin(*open_states))
