"""Sliding windows from panes: partial results of short windows, merged into the longer ones.

A pane is as long as the slide. Each event is summarised in its one pane; only panes, a few
per window, are copied to the windows that hold them. Quantiles come from KLL sketches, which
merge without loss of their error bound, so panes of past days can also be kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Sketch size; the rank of a quantile is then off by less than ``RANK_ERROR`` (99 % confidence).
SKETCH_SIZE, RANK_ERROR = 800, 0.005


def seconds_of(width: str) -> int:
    amount, unit = width.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def pane_partials(
    events: DataFrame, pane: str = "15 minutes", by: Sequence[str] = (), value: str | None = None, size: int = SKETCH_SIZE
) -> DataFrame:
    """(pane, *by, events) and, with ``value``, its number, total, ends and sketch in each pane."""
    number = F.col(value).cast("double") if value else None
    valued = [] if number is None else [
        F.count(number).alias("rows"), F.sum(number).alias("total"), F.min(number).alias("minimum"),
        F.max(number).alias("maximum"), F.kll_sketch_agg_double(number, size).alias("sketch"),
    ]
    grouped = events.groupBy(F.window("ts", pane).alias("w"), *by).agg(F.count("*").alias("events"), *valued)
    return grouped.select(F.col("w.start").alias("pane"), *by, *grouped.columns[1 + len(by) :])


def windows_over(panes: DataFrame, width: str, pane: str) -> DataFrame:
    """Every pane once for each window that holds it, named by the window's start."""
    step, length = seconds_of(pane), seconds_of(width)
    if length % step:
        raise ValueError(f"a window of {width} is not made of whole panes of {pane}")
    starts = F.array(*(F.col("pane") - F.expr(f"INTERVAL '{i * step}' SECOND") for i in range(length // step)))
    return panes.select(F.explode(starts).alias("window_start"), *panes.columns)


def sliding_rate(panes: DataFrame, width: str, pane: str, by: Sequence[str] = ()) -> DataFrame:
    """Events and events per second in each sliding window."""
    merged = windows_over(panes, width, pane).groupBy("window_start", *by).agg(F.sum("events").alias("requests"))
    return merged.withColumn("per_second", F.col("requests") / seconds_of(width))


def sliding_quantiles(
    panes: DataFrame, shares: dict[str, float], width: str, pane: str, by: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """(window_start, *by, rows, one column for each share, sketch) of each sliding window that has a value."""
    valued = windows_over(panes, width, pane).where(F.col("rows") > 0)
    merged = valued.groupBy("window_start", *by).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", size).alias("sketch")
    )
    found = {n: F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for n, s in shares.items()}
    return merged.select("window_start", *by, "rows", *(c.alias(n) for n, c in found.items()), "sketch")


def within_error(
    events: DataFrame, estimates: DataFrame, name: str, share: float, width: str, slide: str,
    value: str = "value", error: float = RANK_ERROR,
) -> DataFrame:
    """(window_start, rows, within_error): whether an estimate's rank among all values of its window is near its share.

    An audit: it copies every event to its windows.
    """
    placed = events.where(F.col(value).isNotNull()).select(F.window("ts", width, slide)["start"].alias("window_start"), value)
    number, estimate = F.col(value).cast("double"), F.col(name)
    ranked = placed.join(estimates.select("window_start", name), "window_start").groupBy("window_start").agg(
        F.count("*").alias("rows"), F.count_if(number < estimate).alias("below"), F.count_if(number <= estimate).alias("upto")
    )
    near = (F.col("upto") / F.col("rows") >= share - error) & (F.col("below") / F.col("rows") <= share + error)
    return ranked.select("window_start", "rows", near.alias("within_error"))
