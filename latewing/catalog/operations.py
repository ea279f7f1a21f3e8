"""Rollups of the event log."""

from __future__ import annotations

from ..operators import panes as P
from ..operators import rollups as R
from ..schema import DURATION_BOUNDS
from ..sources.trips import table
from .registry import query

_START = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start"


def _events(spark, folder):
    return table(spark, folder, "events")


@query(
    "rate_by_window",
    f"SELECT {_START}, count(*) AS requests, round(count(*) / 3600.0, 6) AS per_second FROM events GROUP BY 1",
)
def rate_by_window(spark, folder):
    return R.request_rate(_events(spark, folder))


@query(
    "rate_by_type",
    f"SELECT {_START}, event_type, count(*) AS requests, round(count(*) / 3600.0, 6) AS per_second FROM events GROUP BY 1, 2",
)
def rate_by_type(spark, folder):
    return R.request_rate(_events(spark, folder), by=["event_type"])


@query(
    "sliding_rate",
    """SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS BIGINT)), '%Y-%m-%d %H:%M:%S')
 AS window_start, count(*) AS requests, round(count(*) / 3600.0, 6) AS per_second
FROM events, unnest(range(4)) AS t(k) GROUP BY 1""",
)
def sliding_rate(spark, folder):
    return R.request_rate(_events(spark, folder), "1 hour", "15 minutes")


@query(
    "error_share",
    f"""SELECT {_START}, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
count(*) AS requests, round(100.0 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 6)
 AS error_percent FROM events GROUP BY 1""",
)
def error_share(spark, folder):
    return R.error_share(_events(spark, folder))


@query(
    "p95_by_window",
    f"SELECT {_START}, count(value) AS rows, round(quantile_cont(value, 0.95), 6) AS percentile FROM events GROUP BY 1",
)
def p95_by_window(spark, folder):
    return R.percentile_by_window(_events(spark, folder))


@query(
    "sliding_p95",
    """SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS BIGINT)), '%Y-%m-%d %H:%M:%S')
 AS window_start, count(value) AS rows, round(quantile_cont(value, 0.95), 6) AS percentile
FROM events, unnest(range(4)) AS t(k) GROUP BY 1""",
)
def sliding_p95(spark, folder):
    return R.percentile_by_window(_events(spark, folder), 0.95, "1 hour", "15 minutes")


@query(
    "sliding_p95_panes",
    """SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS BIGINT)), '%Y-%m-%d %H:%M:%S')
 AS window_start, count(value) AS rows, TRUE AS within_error FROM events, unnest(range(4)) AS t(k) WHERE value IS NOT NULL GROUP BY 1""",
)
def sliding_p95_panes(spark, folder):
    """Sketched 95th percentiles of sliding windows, each ranked among its window's values."""
    events, width, pane = _events(spark, folder), "1 hour", "15 minutes"
    merged = P.sliding_quantiles(P.pane_partials(events, pane, value="value"), {"p95": 0.95}, width, pane)
    return P.within_error(events, merged, "p95", 0.95, width, pane)


_BUCKETS = " UNION ALL ".join(
    [
        f"SELECT CAST({i + 1} AS BIGINT) AS position, '{b}' AS le, count(*) FILTER (value <= {b}) AS rows FROM events"
        for i, b in enumerate(DURATION_BOUNDS)
    ]
    + [f"SELECT CAST({len(DURATION_BOUNDS) + 1} AS BIGINT), '+Inf', count(value) FROM events"]
)


@query("bucket_histogram", _BUCKETS)
def bucket_histogram(spark, folder):
    return R.duration_buckets(_events(spark, folder))


@query(
    "state_counts",
    """SELECT event_type, count(*) AS events, round(sum(value), 3) AS value_sum,
strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1""",
    digits=3,
)
def state_counts(spark, folder):
    return R.state_counts(_events(spark, folder))


@query(
    "job_counters",
    """SELECT count(*) FILTER (event_type = 'signup') AS started, count(*) FILTER (event_type = 'purchase') AS succeeded,
count(*) FILTER (event_type = 'error') AS failed, round(sum(value) FILTER (event_type = 'purchase'), 3) AS handled FROM events""",
    digits=3,
)
def job_counters(spark, folder):
    return R.job_counters(_events(spark, folder), "signup", "purchase", "error")


_LATEST = """SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS state,
arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts
FROM events GROUP BY 1"""


@query("latest_state", _LATEST)
def latest_state(spark, folder):
    return R.latest_state(_events(spark, folder))


@query("unfinished_keys", f"WITH latest AS ({_LATEST}) SELECT * FROM latest WHERE state IN ('signup', 'view')")
def unfinished_keys(spark, folder):
    return R.unfinished(_events(spark, folder), ["signup", "view"])
