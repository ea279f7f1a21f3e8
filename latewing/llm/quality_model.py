"""Quality classifier: a generalised additive model with pairwise interactions.

Rows are documents (``doc_id``, ``text``) and labels (``doc_id``, ``quality``); other
columns are ignored by ``predict`` and kept by ``keep``. NULL and empty texts have all
features zero and get a score like any other. Labels that are neither 0 nor 1, and rows
without an id, teach nothing; a ``doc_id`` labelled twice counts twice. Without any
label every score is 0.5, with one class only its smoothed share. No rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .common import batch, ddl, held_out, share_kept, slices

#: About so many labelled rows are learned from; the bound is on the expected number.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 64, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 40, 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper", "digits", "blanks", "stops", "exclaims", "symbols",
    "beyond_ascii", "distinct", "top_word", "same_as_before", "repeated_lines", "log_line",
)

_LOWER, _UPPER, _DIGIT, _BLANK, _STOP, _EXCLAIM, _SYMBOL, _BEYOND = range(8)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _SYMBOL)
    for kind, members in (
        (_LOWER, b"abcdefghijklmnopqrstuvwxyz"), (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"),
        (_BLANK, b" \t\n\v\f\r"), (_STOP, b".,;:'\"()?-"), (_EXCLAIM, b"!"),
    ):
        kinds[list(members)] = kind
    kinds[128:] = _BEYOND
    return kinds.astype(np.uint8)


def features(text: bytes | None, kinds: np.ndarray) -> list[float]:
    """The values of ``FEATURES`` for a whole text."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(kinds[np.frombuffer(text, np.uint8)], minlength=8).tolist()
    size, number = len(text), len(words)
    seen = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = max(1, count[_LOWER] + count[_UPPER] + count[_BEYOND] / 2)
    return [
        float(np.log1p(number)),
        (size - count[_BLANK]) / number,
        count[_UPPER] / letters,
        count[_DIGIT] / size,
        count[_BLANK] / size,
        count[_STOP] / number,
        count[_EXCLAIM] / number,
        count[_SYMBOL] / number,
        count[_BEYOND] / size,
        len(seen) / number,
        max(seen.values()) / number,
        sum(map(eq, words, words[1:])) / number,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair of features, added up in log-odds."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], "right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        if self.edges:
            own = self.bins(values)
            for i, table in enumerate(self.tables):
                total += table[own[:, i]]
            coarse = own * PAIR_BINS // BINS
            for (i, j), table in self.pairs.items():
                total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-total))


def _shallow_tree(slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of at most two levels, from sums of gradients and curvatures."""

    def cut(low: int, high: int) -> tuple[float, int]:
        g, h = np.cumsum(slope[low:high]), np.cumsum(weight[low:high]) + 1e-9
        gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[-1] = 0.0
        best = int(np.argmax(gain))
        return (float(gain[best]), low + best + 1) if gain[best] > 1e-6 else (0.0, high)

    _, middle = cut(0, len(slope))
    bounds = [0, middle, len(slope)]
    for low, high in ((0, middle), (middle, len(slope))):
        if high - low > 1:
            bounds.append(cut(low, high)[1])
    bounds = sorted(set(bounds))
    values = np.zeros(len(slope))
    for low, high in zip(bounds, bounds[1:]):
        values[low:high] = slope[low:high].sum() / (weight[low:high].sum() + 1)
    return values


def _pair_tree(slope: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best quadrant split of a grid."""
    g, h = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def corners(sums: np.ndarray) -> tuple[np.ndarray, ...]:
        a = sums[:-1, :-1]
        return a, sums[:-1, -1:] - a, sums[-1:, :-1] - a, sums[-1, -1] - sums[:-1, -1:] - sums[-1:, :-1] + a

    gain = sum(x**2 / (w + 1) for x, w in zip(corners(g), corners(h)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = np.zeros_like(slope)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            values[rows, columns] = slope[rows, columns].sum() / (weight[rows, columns].sum() + 1)
    return float(gain[i, j]), values


def fit_tables(values: np.ndarray, target: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature in turn one shallow tree, then every chosen pair."""
    positive = (target.sum() + 1) / (len(target) + 2)
    model = AdditiveModel(float(np.log(positive / (1 - positive))))
    if not 0 < target.sum() < len(target):
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(values[:, i], quantiles)) for i in range(values.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    own = model.bins(values)
    total = np.full(len(target), model.base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-total))
        slope = np.bincount(at, target - chance, size)
        return slope, np.bincount(at, chance * (1 - chance), size)

    for _ in range(ROUNDS):
        for i in range(own.shape[1]):
            step = RATE * _shallow_tree(*sums(own[:, i], BINS))
            model.tables[i] += step
            total += step[own[:, i]]
    coarse = own * PAIR_BINS // BINS
    grid = (PAIR_BINS, PAIR_BINS)

    def pair_tree(i: int, j: int) -> tuple[float, np.ndarray]:
        slope, weight = sums(coarse[:, i] * PAIR_BINS + coarse[:, j], PAIR_BINS**2)
        return _pair_tree(slope.reshape(grid), weight.reshape(grid))

    every = [(i, j) for i in range(own.shape[1]) for j in range(i)]
    for i, j in sorted(every, key=lambda p: -pair_tree(*p)[0])[:PAIRS]:
        model.pairs[i, j] = np.zeros(grid)
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * pair_tree(i, j)[1]
            table += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


_VALUES = {"doc_id": pa.int64(), "features": pa.list_(pa.float64())}


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _byte_classes()
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield batch(_VALUES, {"doc_id": part.column(0), "features": [features(t, kinds) for t in texts]})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ddl(_VALUES))


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Learn from a sample of about ``sample`` labelled rows outside the held-out fold.

    ``measured`` is ``with_features`` of the documents, written once. Only the
    sample's feature values, a bounded number, come to the driver.
    """
    taught = (
        measured.where(~held_out(F.col("doc_id")))
        .join(labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("bigint"), "quality"), "doc_id")
        .select("doc_id", "features", F.col("quality").cast("double").alias("quality"))
    )
    taught = staged(taught, "taught")
    number = taught.count()
    chosen = taught if number <= sample else taught.where(share_kept(F.col("doc_id"), sample / number))
    rows = chosen.orderBy("doc_id", "quality").select("features", "quality").toPandas()
    values = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_tables(values, rows["quality"].to_numpy(float))


def predict(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document."""
    measured = staged(with_features(docs), "features")
    model = fit(measured, labels, sample)
    fields = {"doc_id": pa.int64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = part.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield batch(fields, {"doc_id": part.column(0), "score": model.score(values)})

    scored = measured.mapInArrow(run, ddl(fields))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``THRESHOLD``, with all columns."""
    model = fit(staged(with_features(docs), "features"), labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _byte_classes()
        for part in slices(batches):
            texts = part.column(at).cast(pa.binary()).to_pylist()
            values = np.array([features(t, kinds) for t in texts], float).reshape(-1, len(FEATURES))
            yield part.filter(pa.array(model.score(values) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
