import json
from datetime import datetime, timedelta

import pytest
from helpers import DistanceModel, text_rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from latewing.schema import REQUIRED_COLUMNS
from latewing.streaming import jobs
from latewing.streaming.progress import ProgressLog, read_progress
from latewing.streaming.stuck import StuckKeys, keyed_state, settle, stuck_events, stuck_keys

SCHEMA = "user_id bigint, event_id bigint, event_type string, ts timestamp"
START = datetime(2026, 1, 1)


def plain_stuck(events, until, patience):
    ordered = sorted(events)
    found = []
    for here, after in zip(ordered, [*ordered[1:], None]):
        limit = here[0] + patience
        if here[2] == "open" and limit <= until and (after is None or after[0] > limit):
            found.append(here)
    return found


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5), st.sampled_from(["open", "done"])), unique=True, max_size=12),
    st.lists(st.integers(1, 15), max_size=8),
)
def test_settling_step_by_step_equals_one_look(events, steps):
    """However events and watermarks interleave, as long as no event is behind the watermark."""
    rest = sorted(events, key=lambda e: (e[0] + 7 * e[1], e))
    current, waiting, stuck, until, taken = None, [], [], 0, []
    for step in [*steps, 0]:
        arrived, rest = [e for e in rest[:3] if e[0] > until], rest[3:]
        taken += arrived
        current, waiting, found = settle(current, [*waiting, *arrived], until, 9, frozenset(["open"]))
        stuck += found
        until += step
    assert sorted(stuck) == plain_stuck(taken, until, 9)


class Held:
    """State of one key, with its timers, as a stream would hold it."""

    def __init__(self):
        self.timers, self.calls, self.values = set(), 0, {}

    def getValueState(self, name, schema):
        return Variable(self.values, name)

    getListState = getValueState

    def registerTimer(self, when):
        self.calls += 1
        self.timers.add(when)

    def deleteTimer(self, when):
        self.timers.remove(when)


class Variable:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values.get(self.name, None if self.name == "current" else [])

    def update(self, value):
        self.values[self.name] = value

    put = update

    def clear(self):
        self.values.pop(self.name, None)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def micro_batches(held, batches):
    """Event ids that were reported for (events, watermark) after (events, watermark); a timer fires once the watermark is past it."""
    found = []
    for events, watermark in batches:
        step = StuckKeys("user_id", ["open"], 9_000)
        step.init(held)
        rows = [Row(at=a, event_id=e, state=s) for a, e, s in events]
        out = list(step.handleInputRows((1,), iter(rows), Clock(watermark))) if rows else []
        for when in sorted(t for t in held.timers if t < watermark):
            out += step.handleExpiredTimer((1,), Clock(watermark), None)
            held.timers.remove(when)
        found += [row["event_id"] for row in out]
    return found


def test_a_key_has_one_timer_whatever_its_events():
    held = Held()
    events = [(i * 1000, i, "open") for i in range(1, 500)]
    assert micro_batches(held, [(events, 0)]) == [] and len(held.timers) == 1 == held.calls
    assert micro_batches(held, [([], 508)]) == [] and len(held.timers) == 1
    assert micro_batches(held, [([], 509)]) == [499]
    assert not held.timers


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 40), st.integers(0, 5), st.sampled_from(["open", "done"])), unique_by=lambda e: e[:2], max_size=12),
    st.lists(st.integers(1, 15), max_size=8),
)
def test_the_one_timer_finds_what_one_look_finds(events, steps):
    rest = sorted(((t * 1000, 100 * t + n, s) for t, n, s in events), key=lambda e: (e[0] + 7000 * (e[1] % 100), e))
    held, found, taken, until = Held(), [], [], 0
    for step in steps:
        arrived, rest = [e for e in rest[:3] if e[0] > until * 1000], rest[3:]
        taken += arrived
        found += micro_batches(held, [(arrived, until)])
        assert len(held.timers) <= 1
        until += step
    found += micro_batches(held, [([], until), ([], until + 100)])
    assert sorted(found) == sorted(e[1] for e in plain_stuck(taken, (until + 100) * 1000, 9_000))


def test_events_without_id_or_time():
    events = [(1000, None, "done"), (1000, 3, "open"), (None, 4, "open"), (2000, 5, "open")]
    assert micro_batches(Held(), [(events, 0), ([], 100)]) == [5]


def at(minutes):
    return START + timedelta(minutes=minutes)


def deliver(spark, folder, rows):
    spark.createDataFrame([(u, e, s, at(m)) for u, e, s, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    with keyed_state(spark):
        stuck = stuck_keys(stream, ["signup"], timedelta(minutes=30), "5 minutes")
        writer = stuck.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination(300)
    found = spark.read.schema("user_id bigint, state string, event_id bigint, ts timestamp, stuck_at timestamp").parquet(f"{folder}/out")
    return sorted((r["user_id"], r["event_id"], (r["stuck_at"] - START) // timedelta(minutes=1)) for r in found.collect())


def test_stuck_keys_over_several_deliveries(spark, tmp_path):
    folder = str(tmp_path)
    deliver(spark, f"{folder}/in", [(1, 1, "signup", 0), (2, 2, "signup", 0), (3, 3, "done", 1), (4, 4, "signup", 20)])
    assert run(spark, folder) == []
    # User 2 goes on in time; user 1's signup is past its patience, but its next event might still arrive.
    deliver(spark, f"{folder}/in", [(2, 5, "done", 29), (5, 6, "signup", 34)])
    assert run(spark, folder) == []
    # Out of order but within the lateness: saves nobody, for it comes after the 30 minutes.
    deliver(spark, f"{folder}/in", [(1, 7, "done", 31), (6, 8, "done", 45)])
    assert run(spark, folder) == [(1, 1, 30)]
    # Late by the watermark (40): dropped, so user 4 stays stuck. Nothing is reported twice.
    deliver(spark, f"{folder}/in", [(4, 9, "done", 39), (6, 10, "done", 60)])
    assert run(spark, folder) == [(1, 1, 30), (4, 4, 50)]
    assert run(spark, folder) == [(1, 1, 30), (4, 4, 50)]
    deliver(spark, f"{folder}/in", [(6, 11, "done", 500)])
    assert run(spark, folder) == [(1, 1, 30), (4, 4, 50), (5, 6, 64)]


def test_events_without_a_user_are_one_key(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(None, 1, "signup", 0), (7, 2, "signup", 0), (None, 3, "done", 20), (8, None, "signup", 1), (7, 4, "done", 90), (9, 5, "signup", None)]
    table = [(u, e, s, None if m is None else at(m)) for u, e, s, m in rows]
    spark.createDataFrame(table, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    with keyed_state(spark):
        stuck = stuck_keys(stream, ["signup"], timedelta(minutes=30), "5 minutes")
        writer = stuck.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination(300)
    found = spark.read.schema(stuck.schema).parquet(f"{folder}/out").collect()
    assert sorted((r["user_id"], r["event_id"]) for r in found) == [(7, 2), (8, None)]


def test_batch_equals_brute_force(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    until = datetime(2024, 1, 20)
    found = {r["event_id"] for r in stuck_events(events, ["view"], timedelta(hours=30), until).collect()}
    users = {}
    for r in events.collect():
        users.setdefault(r["user_id"], []).append((r["ts"], r["event_id"], "open" if r["event_type"] == "view" else "done"))
    want = {e[1] for own in users.values() for e in plain_stuck(own, until, timedelta(hours=30))}
    assert found == want and want


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_progress_tells_what_became_of_every_row(spark, tmp_path):
    def rows(numbers, day):
        texts = text_rows(40)
        return [{k: texts[i][k] for k in REQUIRED_COLUMNS} | {"event_id": str(i), "ts": f"2026-09-{day:02d} 00:00:00"} for i in numbers]

    log, state, out = (str(tmp_path / n) for n in ("log", "state", "out"))

    def go():
        schema = ", ".join(f"{c} string" for c in [*REQUIRED_COLUMNS, "event_id"]) + ", ts timestamp"
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        once = jobs.without_repeats(stream, "2 days").drop("event_id", "ts")
        with ProgressLog(spark, log) as progress:
            progress.finish(jobs.start_scoring(once, DistanceModel, out, state, availableNow=True))
        names = ("batch", "rows_in", "scored", "quarantined", "late", "repeated")
        return sorted(tuple(r[n] for n in names) for r in read_progress(spark, log).collect())

    first = rows(range(10), 10)
    first[3]["DISTANCE"] = "far"
    drop(tmp_path / "in", "0.json", first)
    assert [r[1:] for r in go()] == [(10, 9, 1, 0, 0)]
    drop(tmp_path / "in", "1.json", [*rows(range(20, 24), 7), *rows(range(8, 13), 9)])
    told = go()
    assert [r[1:] for r in told] == [(10, 9, 1, 0, 0), (9, 3, 0, 4, 2)]
    assert all(r[1] == sum(r[2:]) for r in told)
    assert go() == told  # started again with nothing new: no row is added


def test_progress_needs_its_stream_to_end(spark, tmp_path):
    class Ended:
        runId = "never seen"

        def awaitTermination(self):
            pass

    with ProgressLog(spark, str(tmp_path)) as progress, pytest.raises(TimeoutError):
        progress.finish(Ended(), seconds=0.1)
