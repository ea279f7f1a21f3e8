import numpy as np
import pandas as pd
import pytest

from latewing.operators import distribution as D
from latewing.operators import profile as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(11)
    groups = rng.choice(["hot", "b", "c", None], 5_000, p=[0.7, 0.2, 0.05, 0.05])
    numbers = np.concatenate([rng.normal(0, 50, 2_000), rng.integers(-3, 4, 2_000), rng.exponential(1e-4, 1_000)])
    rows = [(g, float(x)) for g, x in zip(groups, numbers)]
    df = spark.createDataFrame(rows + [("b", None), ("b", float("nan"))], "g string, x double")
    return rows, df


@pytest.mark.parametrize("partitions", [1, 9])
def test_quantiles_equal_numpy(values, partitions):
    rows, df = values
    shares = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.95, "f": 1.0}
    got = D.distribution(df.repartition(partitions), "x", shares, ["g"]).collect()
    assert len(got) == 4
    for r in got:
        xs = [x for g, x in rows if g == r["g"]]
        assert r["rows"] == len(xs)
        assert r["mean"] == pytest.approx(np.mean(xs))
        assert (r["minimum"], r["maximum"]) == (min(xs), max(xs))
        assert [r[n] for n in shares] == pytest.approx(np.quantile(xs, list(shares.values())).tolist(), rel=1e-12)


def test_whole_table_and_weights(values):
    rows, df = values
    xs = [x for _, x in rows]
    whole = D.distribution(df, "x", {"m": 0.5}).collect()
    counted = D.distribution(D.value_counts(df, "x"), "x", {"m": 0.5}, weight="rows").collect()
    assert len(whole) == len(counted) == 1
    for r in (whole[0], counted[0]):
        assert (r["rows"], r["m"]) == (len(xs), pytest.approx(np.median(xs)))


def test_empty(spark):
    empty = spark.createDataFrame([], "x double")
    assert [tuple(r) for r in D.distribution(empty, "x", {"m": 0.5}).collect()] == [(0, None, None, None, None)]


def test_bucket_number_never_falls(spark):
    xs = sorted([0.0, -0.0, 1e-9, -1e-9, 1e-3, 0.5, 1.0, 1.5, 1e6, 1e300, 1.7e308, -5.0, -1e308, -0.2])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    buckets = [r["__b"] for r in D.with_bucket(df.withColumn("n", F.lit(1)), "x", "n").orderBy("i").collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("parts", [5, 10])
def test_equal_share_buckets_equal_pandas(spark, parts):
    xs = [float(x) for x in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7, 7, 7, 9, 12.5]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    expected = pd.qcut(pd.Series(xs), parts, duplicates="drop").cat.codes + 1
    got = dict(D.equal_share_bucket(df, "x", parts).select("x", "bucket").distinct().collect())
    assert [got[x] for x in xs] == expected.tolist()


def test_one_pass_shares_the_counted_exchange(values):
    _, df = values
    plan = D.distribution(df, "x", {"m": 0.5}, ["g"])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text or text.count("Scan ExistingRDD") == 1


def test_describe_and_shape(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, None), (4.0, None)], "x double, s string")
    r = P.describe(df, "x").first()
    assert r["std"] == pytest.approx(np.std([1, 2, 4, 4], ddof=1)) and r["q50"] == 3.0
    assert tuple(P.table_shape(df).first()) == (4, 2, 1)
    profile = {r["column"]: (r["nulls"], r["distinct_values"]) for r in P.column_profile(df).collect()}
    assert profile == {"x": (0, 3), "s": (2, 1)}


def test_close_values_are_spread_evenly(spark):
    close = spark.range(200_000).select((F.col("id") % 3).alias("g"), (1.7e9 + F.col("id") * 85.0).alias("x"))
    counts = D.with_bucket(D.value_counts(close, "x", ["g"]), "x", "rows")
    sizes = [r["count"] for r in counts.groupBy("__b").count().collect()]
    assert len(sizes) == D.PARTS and max(sizes) <= 200_000 // 200
    got = {r["g"]: r["m"] for r in D.distribution(close, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {g: float(np.median(1.7e9 + np.arange(g, 200_000, 3) * 85.0)) for g in range(3)}


def test_buckets_never_fall_as_values_grow(spark):
    some = spark.createDataFrame([(x,) for x in (-float("inf"), -5.0, -0.0, 0.0, 1e-300, 2.0, 1e308, float("inf"))] * 2, "x double")
    rows = D.with_bucket(D.value_counts(some, "x"), "x", "rows").orderBy("x").collect()
    assert [r["__b"] for r in rows] == sorted(r["__b"] for r in rows) and all(0 <= r["__b"] < D.PARTS for r in rows)
    assert D.with_bucket(D.value_counts(some.where("false"), "x"), "x", "rows").count() == 0
