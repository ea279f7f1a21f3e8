"""Keys that stay in an open state, reported by a stream as soon as event time says so.

An event leaves its key stuck when its state is open and the key's next event comes more
than ``patience`` later, or never. Events are held until the watermark has passed them, so
the order in which they arrive and the cut into micro-batches change nothing; what comes
after the watermark is late and is dropped by Spark. A key's state is its newest settled
event, the events of the lateness window and one timer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "at bigint, event_id bigint, state string"
# Waiting events are kept many to a value: every value that is written or read costs a call.
_EVENTS, _CHUNK = "at array<bigint>, event_id array<bigint>, state array<string>", 10_000


#: Many keys: native memory has one limit an executor, and a key that is put is not looked up to be counted.
MANY_KEYS = {"boundedMemoryUsage": "true", "trackTotalNumberOfRows": "false", "compression": "zstd"}


@contextmanager
def keyed_state(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """Streams started inside keep state of any kind by key, with timers; that needs the RocksDB store.

    Its state is on disk: the default store has all keys on the heap of the executors. ``settings`` are its own.
    """
    wanted = {_PROVIDER: _ROCKSDB} | {f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in (settings or {}).items()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _in_time(event: tuple) -> tuple:
    """Order of events; as in SQL, those without an id come last among equal times."""
    at, number, state = event
    return at, number is None, number or 0, state or ""


def settle(
    current: tuple | None, waiting: list[tuple], until: int, patience: int, open_states: frozenset[str]
) -> tuple[tuple | None, list[tuple], list[tuple]]:
    """Newest settled event, events still waiting, and the settled ones that left their key stuck.

    Events are (microseconds, id, state); ``until`` is the last settled microsecond. A settled
    event that was reported is marked by a state of None.
    """
    stuck = []
    ready = sorted((e for e in waiting if e[0] <= until), key=_in_time)
    for event in [*ready, None]:
        limit = until if event is None else event[0] - 1
        if current and current[2] in open_states and current[0] + patience <= limit:
            stuck.append(current)
            current = (*current[:2], None)
        current = event or current
    return current, [e for e in waiting if e[0] > until], stuck


def next_look(
    current: tuple | None, waiting: list[tuple], patience: int, open_states: frozenset[str]
) -> int | None:
    """Millisecond of the one timer a key in this state needs; None if only its next event can change it.

    That is when its first event to be left stuck by what is known becomes so, and
    otherwise when nothing waits any more.
    """
    known = [*([current] if current else []), *sorted(waiting, key=_in_time)]
    for event, following in zip(known, [*known[1:], None]):
        if event[2] in open_states and (following is None or following[0] > event[0] + patience):
            return (event[0] + patience) // 1000
    return (known[-1][0] + patience) // 1000 if waiting else None


class StuckKeys(StatefulProcessor):
    """Emits (key, state, event_id, at); see the module."""

    def __init__(self, key: str, open_states: Sequence[str], patience: int):
        self.key, self.open_states, self.patience = key, frozenset(open_states), patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", _EVENT)
        self.waiting = handle.getListState("waiting", _EVENTS)

    def _keep(self, waiting: list[tuple]) -> None:
        chunks = (waiting[i : i + _CHUNK] for i in range(0, len(waiting), _CHUNK))
        self.waiting.put([tuple(map(list, zip(*c))) for c in chunks]) if waiting else self.waiting.clear()

    def _settled(self, key, arrived: list[tuple], timers) -> Iterator[Row]:
        # The watermark is in milliseconds; rows up to it are late from now on.
        until = timers.getCurrentWatermarkInMs() * 1000
        known = [e for chunk in self.waiting.get() for e in zip(*chunk)]
        current = self.current.get()
        current = tuple(current) if current is not None else None
        timer = next_look(current, known, self.patience, self.open_states)
        newest, waiting, stuck = settle(current, known + arrived, until, self.patience, self.open_states)
        if newest and newest != current:
            self.current.update(newest)
        if waiting != known:
            self._keep(waiting)
        # One timer a key: each costs a call, and many would find nothing to do. A fired one is gone.
        wanted = next_look(newest, waiting, self.patience, self.open_states)
        if wanted != timer:
            if timer is not None and arrived:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        for at, number, state in stuck:
            yield Row(**{self.key: key[0], "state": state, "event_id": number, "at": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Rows, not frames: pandas turns a column that holds a NULL into floats, keys too.
        arrived = [(r["at"], r["event_id"], r["state"]) for r in rows if r["at"] is not None]
        yield from self._settled(key, arrived, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settled(key, [], timerValues)

    def close(self) -> None:
        pass


def stuck_keys(
    events: DataFrame, open_states: Sequence[str], patience: timedelta, lateness: str = "10 minutes", key: str = "user_id"
) -> DataFrame:
    """Stream of events that left their key stuck. Start it inside ``keyed_state`` in append mode."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    held = events.withWatermark("ts", lateness).select(
        key, "ts", micros.alias("at"), "event_id", F.col("event_type").alias("state")
    )
    kind, held_for = dict(events.dtypes)[key], patience // timedelta(microseconds=1)
    stuck = held.groupBy(key).transformWithState(
        StuckKeys(key, open_states, held_for),
        outputStructType=f"`{key}` {kind}, state string, event_id bigint, at bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    ts, stuck_at = (F.timestamp_micros(F.col("at") + F.lit(more)) for more in (0, held_for))
    return stuck.select(key, "state", "event_id", ts.alias("ts"), stuck_at.alias("stuck_at"))


def stuck_events(events: DataFrame, open_states: Sequence[str], patience: timedelta, until, key: str = "user_id") -> DataFrame:
    """The same rows by one batch over all events, for what is known at the time ``until``."""
    from pyspark.sql import Window

    following = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    stuck_at = F.col("ts") + F.lit(patience)
    rows = events.select(key, F.col("event_type").alias("state"), "event_id", "ts", stuck_at.alias("stuck_at"), following.alias("__next"))
    open_row = F.col("state").isin(*open_states) & (F.col("stuck_at") <= F.lit(until))
    return rows.where(open_row & (F.col("__next").isNull() | (F.col("__next") > F.col("stuck_at")))).drop("__next")
