"""Whitening of embeddings by shifted CholeskyQR.

Each Gram pass reads the vectors, centres them, multiplies them by the inverse of the factor
found so far and sums their products by entry; the Cholesky factor of the sum is multiplied
onto the factor R. The shift makes the first factor safe when columns depend on each other;
the passes after it undo what it changed. In the end the centred rows are Q R with Q orthonormal, so the singular vectors
of R are the components and its squared singular values, over the number of rows, the variances.

Rows are vectors (``vec_id`` and an array); other columns are ignored. Entries c become the whole
numbers floor(scale * c), and sums of them are exact. A vector that is NULL or empty, holds a
NULL or a non-finite entry, or is not as long as most are (ties: the longer ones) takes no part. Repeated rows count
as often as they occur and each gets its rows; a NULL ``vec_id`` stays NULL. Directions without variance cannot be whitened and
have no component, so tables of one vector, or none, give no rows. Components of equal variance
come in any order. Entries beyond 2^52 / scale are refused. Only sums cross the network: for D
dimensions a task sends D or D (D + 1) / 2 numbers, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, ddl

#: Gram passes stop when Q's columns are orthonormal up to this, or after so many.
ORTHONORMAL, PASSES = 1e-13, 6
#: Singular values below this share of the largest are rounding.
RANK = 1e-11
_ROUNDING = float(np.finfo(float).eps) / 2
_LARGEST = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """``rows`` vectors were fitted; their whole numbers add up to ``sums``; a component is a column of ``axes``."""

    scale: float
    rows: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total_variance: float
    passes: int

    @property
    def size(self) -> int:
        return len(self.sums)

    def first(self, components: int) -> Whitening:
        return replace(self, axes=self.axes[:, :components], variances=self.variances[:components])

    def deviations(self, whole: np.ndarray) -> np.ndarray:
        """rows * x - sums, exact: whole numbers of 64 bits where they fit, else Python's."""
        wide = self.rows * (int(np.abs(whole).max(initial=0)) + 1) * 2 >= 1 << 62
        return whole.astype(object) * self.rows - self.sums.astype(object) if wide else whole * self.rows - self.sums

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return self.deviations(whole).astype(float) / self.rows

    def project(self, whole: np.ndarray) -> np.ndarray:
        return self.centred(whole) @ self.axes / np.sqrt(self.variances)


def vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and the vectors that can take part, whatever their length."""
    ok = F.size(column) > 0
    ok &= ~F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(ok).select("vec_id", F.col(column).cast("array<double>").alias("vector"))


def common_size(df: DataFrame) -> int:
    """The length that most vectors have; one row for each length is ordered, one fetched. No rows: 0."""
    sizes = df.groupBy(F.size("vector").alias("size")).count()
    best = sizes.orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return best["size"] if best else 0


def _whole(part: pa.RecordBatch, size: int, scale: float) -> np.ndarray:
    values = np.floor(scale * part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False))
    if np.abs(values).max(initial=0.0) > _LARGEST:
        raise ValueError(f"an entry times {scale} is beyond 2^52")
    return values.astype(np.int64).reshape(-1, size)


def _summed(df: DataFrame, size: int, scale: float, start: Callable[[], object], add: Callable, rows: Callable, kind: str) -> DataFrame:
    """One state for each task, built from its batches; its rows (``at``, ``amount``) are summed by ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for part in batches:
            if part.num_rows:
                state = add(state, _whole(part, size, scale))
        at, amount = rows(state)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(amount)], names=["at", "amount"])

    return df.select("vector").mapInArrow(run, f"at int, amount {kind}").groupBy("at").agg(F.sum("amount").alias("amount"))


def column_sums(df: DataFrame, size: int, scale: float) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension.

    Entries are summed in two halves of 32 bits, which no 2^31 rows overflow; the halves meet as decimals.
    """

    def add(state: np.ndarray, whole: np.ndarray) -> np.ndarray:
        high = whole >> 32
        state[:size] += high.sum(axis=0)
        state[size:-1] += (whole - (high << 32)).sum(axis=0)
        state[-1] += len(whole)
        return state

    amounts = _summed(
        df, size, scale, lambda: np.zeros(2 * size + 1, np.int64), add, lambda s: (np.arange(len(s)), s), "bigint"
    ).collect()
    found = {r["at"]: r["amount"] for r in amounts}
    sums = [(found.get(i, 0) << 32) + found.get(size + i, 0) for i in range(size)]
    wide = any(abs(s) >= 1 << 62 for s in sums)
    return found.get(2 * size, 0), np.array(sums, object if wide else np.int64)


def gram(df: DataFrame, size: int, scale: float, columns: int, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of transformed rows, by one pass over ``df``."""
    upper = np.triu_indices(columns)

    def add(state: np.ndarray, whole: np.ndarray) -> np.ndarray:
        rows = transform(whole)
        return state + rows.T @ rows

    amounts = _summed(
        df, size, scale, lambda: np.zeros((columns, columns)), add,
        lambda s: (np.arange(len(upper[0])), s[upper]), "double",
    ).toArrow()
    own = np.zeros(len(upper[0]))
    own[amounts["at"].to_numpy()] = amounts["amount"].to_numpy()
    whole = np.zeros((columns, columns))
    whole[upper] = own
    return whole + np.triu(whole, 1).T


def shifted_cholesky(products: np.ndarray, rows: int, always: bool) -> np.ndarray:
    """Upper factor of a Gram matrix, with the smallest shift that lets it exist.

    The first pass is always shifted: its matrix may be as ill-conditioned as the square of the data's.
    """
    size = len(products)
    least = 11 * (rows * size + size * (size + 1)) * _ROUNDING * float(np.linalg.norm(products, 2))
    # Rounding of sums grows far slower than its bound; at worst a later pass repeats the step.
    shift = min(least, 1e-10 * float(np.trace(products))) if always else 0.0
    while True:
        try:
            return np.linalg.cholesky(products + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-14 * float(np.trace(products)))


def fit(df: DataFrame, scale: float = 1.0) -> Whitening | None:
    """Whitening of the vectors of ``df`` (``vector``, all of one length); None if nothing varies."""
    first = df.first()
    if first is None:
        return None
    size = len(first["vector"])
    rows, sums = column_sums(df, size, scale)
    plain = Whitening(scale, rows, sums, np.empty((size, 0)), np.empty(0), 0.0, 0)
    factor, passes, total = np.eye(size), 0, 0.0
    for passes in range(1, PASSES + 1):
        known = factor

        def solved(whole: np.ndarray, known=known, first=passes == 1) -> np.ndarray:
            return plain.centred(whole) if first else np.linalg.solve(known.T, plain.centred(whole).T).T

        products = gram(df, size, scale, size, solved)
        if passes == 1:
            total = float(np.trace(products)) / rows
            if total == 0:
                return None
        elif float(np.abs(products - np.eye(size)).max()) <= ORTHONORMAL * rows**0.5:
            break
        factor = shifted_cholesky(products, rows, passes == 1) @ factor
    _, singular, axes = np.linalg.svd(factor)
    kept = singular > RANK * singular[0]
    return Whitening(scale, rows, sums, axes[kept].T, singular[kept] ** 2 / rows, total, passes)


def identity_error(df: DataFrame, model: Whitening) -> float:
    """Largest difference between the covariance of whitened rows and the identity, by two more passes."""
    held = len(model.variances)
    means = _summed(
        df, model.size, model.scale, lambda: np.zeros(held), lambda s, whole: s + model.project(whole).sum(axis=0),
        lambda s: (np.arange(held), s), "double",
    ).collect()
    mean = np.array([amount for _, amount in sorted((r["at"], r["amount"]) for r in means)]) / model.rows
    products = gram(df, model.size, model.scale, held, lambda whole: model.project(whole) - mean)
    return float(np.abs(products / model.rows - np.eye(held)).max())


_ROW = {
    "vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(),
    "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64(),
}


def _exact_squares(deviations: np.ndarray) -> list[int]:
    """Sum of squares of each row, in Python's whole numbers where 64 bits may not hold them."""
    largest = int(np.abs(deviations).max(initial=0))
    if largest * largest * deviations.shape[1] < 1 << 63:
        return (deviations.astype(np.int64) ** 2).sum(axis=1).tolist()
    sums = [sum(int(v) * int(v) for v in row) for row in deviations]
    if max(sums) >= 1 << 63:
        raise ValueError("a deviation does not fit 64 bits")
    return sums


def whiten(df: DataFrame, components: int = 32, scale: float = 64.0, column: str = "embedding") -> DataFrame:
    """One row for each vector and component, components numbered from 1 by falling variance.

    ``deviation`` is the exact squared length of n * x - S, ``explained`` the component's share of
    the variance, ``identity_error`` the same check of the whole result in every row.
    """
    found = vectors(df, column)
    size = common_size(found)
    held = found.where(F.size("vector") == size)
    model = fit(held, scale) if size else None
    if model is None:
        return df.sparkSession.createDataFrame([], ddl(_ROW))
    own = model.first(components)
    count, error, explained = len(own.variances), identity_error(held, own), own.variances / own.total_variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 2048):
                part = whole_batch.slice(start, 2048)
                whole = _whole(part, size, scale)
                times, places = np.repeat(np.arange(len(whole)), count), np.tile(np.arange(count), len(whole))
                yield batch(_ROW, {
                    "vec_id": part.column(0).take(pa.array(times)),
                    "component": places + 1,
                    "n": np.full(len(times), own.rows),
                    "deviation": np.array(_exact_squares(own.deviations(whole)), np.int64)[times],
                    "whitened": own.project(whole).ravel(),
                    "explained": explained[places],
                    "identity_error": np.full(len(times), error),
                })

    return held.select(F.col("vec_id").cast("bigint"), "vector").mapInArrow(run, ddl(_ROW))
