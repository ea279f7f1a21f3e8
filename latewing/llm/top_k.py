"""Exact top-k search by inner product over a pivot-distance index.

Rows are vectors (``vec_id``, ``embedding``); other columns are ignored. Components x
become floor(64 * x). A vector that is NULL or holds a NULL or non-finite component, or whose id is
NULL, takes no part. Missing components of a shorter vector count as 0; an empty vector scores 0. Of
rows with the same id the vector first in order stays. A query gets all others if they are
fewer than k; equal scores go to the smaller id. No rows give no rows. A component beyond
2**23 after scaling raises an error, so that scores are exact.

Inner products become distances: a vector x gets one more coordinate sqrt(M - |x|^2), M
being the largest squared length, and a query q gets 0. Then |q - x|^2 = |q|^2 + M - 2 q.x,
the nearest is the best, and the triangle inequality holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .common import batch, ddl

SCALE, K, QUERY_STEP = 64, 20, 20
#: Pivots, and the size of the sample that they are chosen from.
PIVOTS, SAMPLE = 32, 2048
#: Vectors of an annulus, queries of a block, and annuli that one task expands for a block.
ANNULUS, QUERIES, EXPANDED = 2048, 512, 64
_LARGEST = 1 << 23


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part, one row per id."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.forall("embedding", finite))
    return rows.select(F.col("vec_id").cast("bigint"), whole.alias("vector")).groupBy("vec_id").agg(
        F.min("vector").alias("vector")
    )


def choose_pivots(sample: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Points far from each other, moved to the middle of what is nearest to them."""
    pivots = sample[:1]
    gap = np.full(len(sample), np.inf)
    while len(pivots) < min(PIVOTS, len(sample)):
        gap = np.minimum(gap, ((sample - pivots[-1]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        pivots = np.vstack([pivots, sample[int(gap.argmax())]])
    for _ in range(rounds):
        nearest = distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[nearest == i].mean(axis=0) if (nearest == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


class Space:
    """The lifted space: dimension, largest squared length, pivots, and exact number types."""

    def __init__(self, size: int, largest: float, component: int):
        self.size, self.largest = size, largest
        self.stored = np.int8 if component < 128 else np.int16 if component < 1 << 15 else np.int32
        self.exact = np.float32 if size * component**2 < 1 << 24 else np.float64
        self.pivots = np.empty((0, size + 1))

    def matrix(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.size))
        lengths = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(column)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[row, at] = column.flatten().to_numpy()
        return out

    def lift(self, points: np.ndarray) -> np.ndarray:
        return np.hstack([points, np.sqrt(np.maximum(self.largest - (points**2).sum(axis=1), 0))[:, None]])

    def from_query(self, queries: np.ndarray) -> np.ndarray:
        """Distance of each query from each pivot."""
        return distances(np.hstack([queries, np.zeros((len(queries), 1))]), self.pivots)

    def reach(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far a vector may be to have at least that score; a little more, for rounding."""
        squares = (queries**2).sum(axis=1) + self.largest - 2 * score
        return np.sqrt(np.maximum(squares, 0)) * (1 + 1e-9) + 1e-4

    def load(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.stored).reshape(-1, self.size).astype(self.exact)

    def dump(self, points: np.ndarray) -> bytes:
        return points.astype(self.stored).tobytes()


def best_scores(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where a row has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


_KEYED = {"vec_id": pa.int64(), "pivot": pa.int32(), "distance": pa.float64(), "point": pa.binary()}
_BLOCK = {
    "block": pa.int64(), "pivot": pa.int32(), "low": pa.float64(), "high": pa.float64(), "ids": pa.binary(),
    "points": pa.binary(), "query_ids": pa.binary(), "query_points": pa.binary(), "query_scores": pa.binary(),
}
_ASKED = {"asker": pa.int64(), "query_ids": pa.binary(), "query_points": pa.binary(), "query_scores": pa.binary()}
_NEED = {"asker": pa.int64(), "pivot": pa.int32(), "from": pa.float64(), "to": pa.float64(), "centre": pa.float64()}
_FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def _measure(rows: DataFrame) -> Space | None:
    found = rows.agg(
        F.max(F.size("vector")).alias("size"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("largest"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("component"),
    ).first()
    if found["size"] is None:
        return None
    if (found["component"] or 0) > _LARGEST:
        raise ValueError(f"a scaled component is beyond {_LARGEST}")
    return Space(found["size"], found["largest"], found["component"] or 0)


def build_index(rows: DataFrame, space: Space, k: int, step: int) -> DataFrame:
    """Annuli: runs of at most ``ANNULUS`` vectors of one pivot, in order of distance.

    Range partitioning by pivot, distance and id cuts a crowded pivot into as many
    tasks as it needs. Each annulus also holds its own queries and the k-th best score that
    they find in it, the bound they start with.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            points = space.matrix(part.column(1))
            away = distances(space.lift(points), space.pivots)
            pivot = away.argmin(axis=1)
            yield batch(_KEYED, {
                "vec_id": part.column(0), "pivot": pivot, "distance": away[np.arange(len(pivot)), pivot],
                "point": [space.dump(p) for p in points],
            })

    def block(pivot: int, away: np.ndarray, ids: np.ndarray, raw: list[bytes]) -> dict:
        points, asks = space.load(b"".join(raw)), ids % step == 0
        scores = points[asks] @ points.T
        scores[ids[asks][:, None] == ids] = -np.inf
        return {
            "block": int(ids[0]), "pivot": pivot, "low": float(away[0]), "high": float(away[-1]),
            "ids": ids.tobytes(), "points": b"".join(raw), "query_ids": ids[asks].tobytes(),
            "query_points": space.dump(points[asks]),
            "query_scores": np.where(np.isneginf(s := best_scores(scores, k)), -np.inf, s).astype(float).tobytes(),
        }

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for part in batches:
            kept.extend(zip(*(part.column(i).to_pylist() for i in range(4))))
            yield from cut(kept, False)
        yield from cut(kept, True)

    def cut(kept: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
        while kept and (last or len(kept) > ANNULUS):
            size = next((i for i, r in enumerate(kept[:ANNULUS]) if r[1] != kept[0][1]), min(ANNULUS, len(kept)))
            ids, pivots, away, raw = zip(*kept[:size])
            del kept[:size]
            made = block(pivots[0], np.array(away), np.array(ids, np.int64), list(raw))
            yield batch(_BLOCK, {name: [value] for name, value in made.items()})

    order = ["pivot", "distance", "vec_id"]
    keyed = staged(rows.mapInArrow(key, ddl(_KEYED)), "keyed")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(annuli, ddl(_BLOCK))


def _askers(index: DataFrame) -> DataFrame:
    """Queries of neighbouring annuli, put together up to ``QUERIES`` a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[bytes] = [b"", b"", b""]
        for part in batches:
            for own in zip(*(part.column(i).to_pylist() for i in range(3))):
                if kept[0] and len(kept[0]) + len(own[0]) > 8 * QUERIES:
                    yield row(kept)
                    kept = [b"", b"", b""]
                kept = [a + b for a, b in zip(kept, own)]
        if kept[0]:
            yield row(kept)

    def row(kept: list[bytes]) -> pa.RecordBatch:
        first = int(np.frombuffer(kept[0], np.int64)[0])
        return batch(_ASKED, {"asker": [first]} | {n: [v] for n, v in zip(list(_ASKED)[1:], kept)})

    return index.select("query_ids", "query_points", "query_scores").mapInArrow(run, ddl(_ASKED))


def search(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """The ``k`` best of all vectors for those with an id divisible by ``step``.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``. A block of queries meets an
    annulus only where some query's reach touches it. The pairs of a block are dealt
    to tasks of at most ``EXPANDED`` annuli in order of their gap, and a task leaves out an annulus that lies
    beyond the reach a query has by then.
    """
    spark = vectors.sparkSession
    rows = staged(scaled(vectors), "scaled")
    space = _measure(rows)
    if space is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    points = space.matrix(sample["vector"].combine_chunks())
    space.pivots = choose_pivots(space.lift(points))

    index = staged(build_index(rows, space, k, step), "annuli")
    asked = staged(_askers(index), "queries")

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for asker, points, scores in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                queries = space.load(points).astype(float)
                away, reach = space.from_query(queries), space.reach(queries, np.frombuffer(scores))[:, None]
                open_ = (away - away.min(axis=1, keepdims=True)) / 2 <= reach
                low = np.where(open_, away - reach, np.inf).min(axis=0)
                high = np.where(open_, away + reach, -np.inf).max(axis=0)
                at = np.flatnonzero(open_.any(axis=0))
                yield batch(_NEED, {
                    "asker": np.full(len(at), asker), "pivot": at, "from": low[at], "to": high[at],
                    "centre": np.median(away, axis=0)[at],
                })

    need = asked.select(*_ASKED).mapInArrow(needs, ddl(_NEED))
    rings = index.select("block", "pivot", "low", "high")
    gap = F.greatest(F.col("low") - F.col("centre"), F.col("centre") - F.col("high"), F.lit(0.0))
    pairs = need.join(rings, "pivot").where("low <= `to` AND high >= `from`").select("asker", "block", gap.alias("gap"))
    dealt = pairs.withColumn(
        "turn", F.floor((F.row_number().over(Window.partitionBy("asker").orderBy("gap", "block")) - 1) / EXPANDED)
    )
    met = (
        dealt.join(index.select("block", "pivot", "low", "high", "ids", "points"), "block")
        .join(asked, "asker")
        .repartition("asker", "turn")
        .sortWithinPartitions("asker", "turn", "gap", "block")
        .select("asker", "turn", "pivot", "low", "high", "ids", "points", "query_ids", "query_points", "query_scores")
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for part in batches:
            for i in range(part.num_rows):
                asker, turn, pivot, low, high, ids, points, *asks = (c[i].as_py() for c in part.columns)
                if (asker, turn) != now:
                    if own:
                        yield own.found()
                    now, own = (asker, turn), Expansion(space, k, *asks)
                own.meet(pivot, low, high, np.frombuffer(ids, np.int64), points)
        if own:
            yield own.found()

    best = met.mapInArrow(expand, ddl(_FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Expansion:
    """The best k so far of a block of queries, while annuli are added."""

    def __init__(self, space: Space, k: int, ids: bytes, points: bytes, scores: bytes):
        self.space, self.k = space, k
        self.ids, self.points = np.frombuffer(ids, np.int64), space.load(points)
        self.away = space.from_query(self.points.astype(float))
        self.nearest = self.away.min(axis=1)
        self.bound = np.frombuffer(scores).copy()
        self.reach = space.reach(self.points.astype(float), self.bound)
        #: (query, id, score), the best k of each query.
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def meet(self, pivot: int, low: float, high: float, ids: np.ndarray, points: bytes) -> None:
        away = self.away[:, pivot]
        gap = np.maximum(np.maximum(low - away, away - high), (away - self.nearest) / 2)
        asks = np.flatnonzero(gap <= self.reach)
        if not len(asks):
            return
        scores = self.points[asks] @ self.space.load(points).T
        good = (scores >= self.bound[asks][:, None]) & (self.ids[asks][:, None] != ids)
        row, column = np.nonzero(good)
        query, vec, score = (
            np.concatenate(pair)
            for pair in zip(self.held, (asks[row], ids[column], scores[row, column].astype(float)))
        )
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(query)))
        rank = np.arange(len(query)) - np.repeat(first, size)
        full = first[size >= self.k]
        self.bound[query[full]] = np.maximum(self.bound[query[full]], score[full + self.k - 1])
        self.reach[query[full]] = self.space.reach(self.points[query[full]].astype(float), self.bound[query[full]])
        self.held = query[rank < self.k], vec[rank < self.k], score[rank < self.k]

    def found(self) -> pa.RecordBatch:
        query, vec, score = self.held
        return batch(_FOUND, {"query_id": self.ids[query], "vec_id": vec, "score": score.astype(np.int64)})
