"""Exact count, mean and quantiles of a value, whole or per group.

Equal values are counted before the shuffle, so a hot group shrinks to its
distinct values. A quantile sketch of these counted rows gives edges that cut them
into buckets of about equal size, however close the values are; bucket totals alone
tell which bucket holds a wanted rank, and only those buckets are sorted. A bucket
of one group is part of a bucket of all groups, so no task sorts more than about
``1 / PARTS`` of the counted rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of about equal size; a square number.
PARTS = 256
#: The sketch places an edge within 1 / _ACCURACY of the counted rows.
_ACCURACY = 10_000


def with_bucket(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """``counts`` with ``__b``, from 0 to ``PARTS - 1``, which never decreases as the value grows.

    The edges are one row of constant size, read as a scalar subquery. It asks for the
    weight only to have the same columns as ``counts``: so both read one shuffle.
    """
    shares = F.expr(f"array({', '.join(f'{i / PARTS}D' for i in range(1, PARTS))})")
    sketched = F.percentile_approx(F.when(F.col(weight) > 0, F.col(value)), shares, _ACCURACY)
    edged = counts.withColumn("__edges", counts.select(sketched.alias("edges")).scalar())
    # Number of edges up to the value: whole blocks of edges first, then those inside the next block.
    block = math.isqrt(PARTS)
    blocks = _passed(value, [F.lit(block * i - 1) for i in range(1, block)])
    inside = _passed(value, [F.col("__blocks") * block + i for i in range(block - 1)])
    edged = edged.withColumn("__blocks", blocks)
    # Never NULL: a null check on one side of a later join would stop Spark
    # from sharing the counted exchange between both sides.
    return edged.select(*counts.columns, F.coalesce(F.col("__blocks") * block + inside, F.lit(0)).alias("__b"))


def _passed(value: str, places: list[Column]) -> Column:
    return reduce(add, [(F.get("__edges", place) <= F.col(value)).cast("int") for place in places])


def value_counts(df: DataFrame, value: str, by=(), weight: str = "rows") -> DataFrame:
    """One row per group and distinct value with its number of rows; NULL and NaN left out."""
    number = F.col(value).cast("double")
    return (
        df.where(number.isNotNull() & ~F.isnan(number))
        .select(*by, number.alias(value))
        .groupBy(*by, value)
        .agg(F.count("*").alias(weight))
    )


def distribution(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    by=(),
    sums: dict[str, Column] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per group: ``rows, mean, minimum, maximum`` and linearly interpolated quantiles by name.

    ``sums`` adds row-weighted sums of expressions over the value column.
    ``weight`` names a count column when ``df`` already holds value counts.
    Without ``by`` there is always exactly one row.
    """
    by = list(by)
    sums = sums or {}
    number = F.col(value).cast("double")
    if weight is None:
        counts = value_counts(df, value, by, "__n")
    else:
        counts = (
            df.where(number.isNotNull() & ~F.isnan(number))
            .select(*by, number.alias(value), F.col(weight).alias("__n"))
            .groupBy(*by, value)
            .agg(F.sum("__n").alias("__n"))
        )
    counts = with_bucket(counts, value, "__n")

    buckets = counts.groupBy(*by, "__b").agg(
        F.sum("__n").alias("__bn"),
        F.sum(F.col(value) * F.col("__n")).alias("__sum"),
        F.min(value).alias("__min"),
        F.max(value).alias("__max"),
        *(F.sum(expr * F.col("__n")).alias(name) for name, expr in sums.items()),
    )
    # At most one row per bucket number, whatever the number of trips.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = buckets.select(
        *by,
        "__b",
        (F.sum("__bn").over(upto) - F.col("__bn")).alias("__start"),
        F.sum("__bn").over(upto).alias("__end"),
        F.struct(
            F.sum("__bn").over(group).alias("rows"),
            F.sum("__sum").over(group).alias("value_sum"),
            F.min("__min").over(group).alias("minimum"),
            F.max("__max").over(group).alias("maximum"),
            *(F.sum(name).over(group).alias(name) for name in sums),
        ).alias("__all"),
    )
    shares = F.array(*(F.lit(float(q)) for q in quantiles.values())) if quantiles else F.array(F.lit(0.0))
    spots = F.transform(shares, lambda q: q * (F.col("__all.rows") - 1))
    # Wanted 0-based ranks that fall inside this bucket, each with its place in the result.
    ranks = F.flatten(F.transform(spots, lambda s: F.array(F.floor(s), F.ceil(s))))
    holders = (
        placed.withColumn("__ranks", ranks)
        .where(F.exists("__ranks", lambda r: (r >= F.col("__start")) & (r < F.col("__end"))))
        .select(
            *(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)),
            F.col("__b").alias("__kb"),
            "__start",
            "__ranks",
            "__all",
        )
    )
    match = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    located = counts.join(holders, match).select(
        *by,
        value,
        "__ranks",
        "__all",
        (F.col("__start") + F.sum("__n").over(inside)).alias("__next"),
        F.col("__n"),
    )

    def at_rank(i: int) -> Column:
        rank = F.col("__ranks")[i]
        return F.max(F.when((rank < F.col("__next")) & (rank >= F.col("__next") - F.col("__n")), F.col(value)))

    whole = located.groupBy(*by).agg(
        F.first("__all").alias("__all"),
        *(at_rank(i).alias(f"__v{i}") for i in range(2 * len(quantiles))),
    )
    total = F.col("__all")
    results = []
    for i, (name, share) in enumerate(quantiles.items()):
        low, high = F.col(f"__v{2 * i}"), F.col(f"__v{2 * i + 1}")
        spot = F.lit(float(share)) * (total["rows"] - 1)
        results.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return whole.select(
        *by,
        F.coalesce(total["rows"], F.lit(0)).alias("rows"),
        (total["value_sum"] / total["rows"]).alias("mean"),
        total["minimum"].alias("minimum"),
        total["maximum"].alias("maximum"),
        *results,
        *(total[name].alias(name) for name in sums),
    )


def scalar_row(one_row: DataFrame) -> Column:
    """A one-row frame as one struct-valued scalar subquery.

    Attach it as a column and read its fields in a later projection, so that the
    subquery appears once in the plan.
    """
    return one_row.select(F.struct(*one_row.columns).alias("row")).scalar()


def equal_share_edges(df: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """One row with columns ``edge0 .. edgeN``: the quantiles that cut into equal shares."""
    names = {f"edge{i}": i / parts for i in range(parts + 1)}
    return distribution(df, value, names).select(*names)


def equal_share_bucket(df: DataFrame, value: str, parts: int = 10, output: str = "bucket") -> DataFrame:
    """Number (from 1) of the right-closed equal-share bucket; repeated edges count once.

    The edges are one row of constant size and become literals of the second pass.
    """
    row = equal_share_edges(df, value, parts).first()
    edges = sorted({edge for edge in row if edge is not None})
    x = F.col(value).cast("double")
    passed = F.lit(0)
    for edge in edges[1:-1]:
        passed = passed + (x > edge).cast("int")
    return df.withColumn(output, F.when(x.isNotNull() & ~F.isnan(x), passed + 1))


def group_statistics(df: DataFrame, value: str, by, min_rows: int = 1) -> DataFrame:
    """Mean, median and count per group; NULL groups dropped, small groups too."""
    by = [by] if isinstance(by, str) else list(by)
    keyed = df
    for key in by:
        keyed = keyed.where(F.col(key).isNotNull())
    stats = distribution(keyed, value, {"median": 0.5}, by)
    return stats.where(F.col("rows") >= min_rows)


