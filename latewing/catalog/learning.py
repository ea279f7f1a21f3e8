"""Split, encoding, training, evaluation and scoring queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import encoding as E
from ..operators import metrics as M
from ..operators import modeling
from ..operators.cleaning import clean, usable_rows
from ..operators.features import with_features
from ..operators.scoring import score_features, score_text
from ..operators.split import earliest, find_cut, fold_of, labelled, labelled_split
from ..plans.batch_scoring import quarantine
from ..plans.training import TrainingSettings, train
from ..schema import PREDICTION, TARGET
from ..session import staged
from ..sources.trips import RECORD_KEY, parts_by_size, text_trips, trip_facts, trips, with_places
from .quality import _RULES
from .registry import CLEAN, FACTS, RECORD_ORDER, TEXT, TRIPS, USABLE, clean_view, query

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"
SETTINGS = TrainingSettings(record_key=RECORD_KEY)


def _clean_trips(spark, folder):
    return with_places(clean(trip_facts(spark, folder)), folder)


def _early_and_late(spark, folder):
    """All trips with their lane; ``split`` marks the earliest four fifths, on which encoders are fitted.

    In the rest the lanes of some places carry a new name, so that categories are unseen at
    every size. The cut is found before the joins.
    """
    facts = trip_facts(spark, folder)
    cut = find_cut(facts, lambda total: total * 4 // 5, RECORD_KEY)
    parts = with_places(labelled(facts, cut, RECORD_KEY, ("early", "late")), folder)
    ends = sum(F.ascii(F.right(place, F.lit(1))) for place in (F.col("ORIGIN"), F.col("DEST")))
    renamed = (F.col("split") == "late") & (ends % 5 == 0)
    lane = F.concat_ws("_", "OP_UNIQUE_CARRIER", "ORIGIN", "DEST")
    return parts.withColumn("lane", F.when(renamed, F.concat(lane, F.lit("_new"))).otherwise(lane))


class DistanceModel:
    """A model in plain Python: one minute per 100 miles."""

    def predict(self, frame):
        return frame["DISTANCE"] / 100


_FACT_SPLIT = f"""{clean_view(FACTS, 'facts')}, ranked AS (SELECT *, row_number() OVER (ORDER BY {RECORD_ORDER}) AS r,
 count(*) OVER () AS total FROM clean),
parts AS (SELECT *, CASE WHEN r <= floor(total * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM ranked)"""


@query(
    "chrono_split",
    f"""WITH {_FACT_SPLIT} SELECT split, count(*) AS n, strftime(min(FL_DATE), '%Y-%m-%d') AS first_day,
strftime(max(FL_DATE), '%Y-%m-%d') AS last_day, CAST(sum(l_orderkey) AS BIGINT) AS key_sum,
CAST(sum(l_partkey) AS BIGINT) AS part_sum FROM parts GROUP BY 1""",
)
def chrono_split(spark, folder):
    # A split needs no places, so the records are not joined.
    return labelled_split(clean(trip_facts(spark, folder)), RECORD_KEY).groupBy("split").agg(
        F.count("*").alias("n"),
        F.min("FL_DATE").cast("date").alias("first_day"),
        F.max("FL_DATE").cast("date").alias("last_day"),
        F.sum("l_orderkey").alias("key_sum"),
        F.sum("l_partkey").alias("part_sum"),
    )


@query(
    "earliest_n",
    f"""WITH {FACTS} SELECT strftime(FL_DATE, '%Y-%m-%d') AS day, {KEYS_SQL}, DISTANCE FROM facts
ORDER BY {RECORD_ORDER} LIMIT 1000""",
)
def earliest_n(spark, folder):
    rows = earliest(trip_facts(spark, folder), 1000, RECORD_KEY)
    return rows.select(F.col("FL_DATE").cast("date").alias("day"), *KEYS, "DISTANCE")


@query(
    "target_encode_fit",
    f"""WITH {CLEAN}, g AS (SELECT avg(ARR_DELAY) AS prior FROM clean),
long AS (SELECT 'ORIGIN' AS feature, ORIGIN AS category, ARR_DELAY AS y FROM clean
 UNION ALL SELECT 'route', concat(ORIGIN, '_', DEST), ARR_DELAY FROM clean)
SELECT feature, category, round((sum(y) + 10 * any_value(prior)) / (count(y) + 10), 6) AS encoded FROM long, g
GROUP BY feature, category""",
)
def target_encode_fit(spark, folder):
    df = with_features(_clean_trips(spark, folder))
    return E.TargetEncoder(["ORIGIN", "route"]).fit(df, TARGET).mapping


_EARLY = f"""{TRIPS}, numbered AS (SELECT *, row_number() OVER (ORDER BY {RECORD_ORDER}) AS r,
 count(*) OVER () * 4 // 5 AS cut FROM trips),
ranked AS (SELECT *, concat(OP_UNIQUE_CARRIER, '_', ORIGIN, '_', DEST,
 CASE WHEN r > cut AND (ascii(right(ORIGIN, 1)) + ascii(right(DEST, 1))) % 5 = 0 THEN '_new' ELSE '' END) AS lane FROM numbered),
early AS (SELECT * FROM ranked WHERE r <= cut)"""


@query(
    "target_encode",
    f"""WITH {_EARLY}, g AS (SELECT avg(ARR_DELAY) AS prior FROM early),
m AS (SELECT lane, (sum(ARR_DELAY) + 10 * any_value(prior)) / (count(ARR_DELAY) + 10) AS encoded FROM early, g
 WHERE ARR_DELAY IS NOT NULL GROUP BY 1)
SELECT t.lane, round(coalesce(m.encoded, prior), 6) AS lane_encoded, count(*) AS n
FROM ranked t LEFT JOIN m ON t.lane = m.lane, g GROUP BY ALL""",
)
def target_encode(spark, folder):
    df = _early_and_late(spark, folder)
    encoding = E.TargetEncoder(["lane"]).fit(df.where("split = 'early'"), TARGET)
    return encoding.transform(df).groupBy("lane", "lane_encoded").agg(F.count("*").alias("n"))


@query(
    "target_encode_oof",
    f"""WITH {CLEAN}, d AS (SELECT concat(ORIGIN, '_', DEST) AS route, OP_UNIQUE_CARRIER AS carrier,
 CAST(l_orderkey % 5 AS BIGINT) AS fold, ARR_DELAY AS y FROM clean),
g AS (SELECT f.fold, avg(d.y) AS prior FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY 1),
cells AS (SELECT route, carrier, fold, count(*) AS n FROM d GROUP BY ALL),
by_route AS (SELECT k.route, k.fold, sum(d.y) AS s, count(d.y) AS c FROM (SELECT DISTINCT route, fold FROM d) k
 LEFT JOIN d ON d.route = k.route AND d.fold <> k.fold GROUP BY ALL),
by_carrier AS (SELECT k.carrier, k.fold, sum(d.y) AS s, count(d.y) AS c FROM (SELECT DISTINCT carrier, fold FROM d) k
 LEFT JOIN d ON d.carrier = k.carrier AND d.fold <> k.fold GROUP BY ALL)
SELECT x.route, x.carrier, x.fold, x.n, round((coalesce(r.s, 0) + 10 * prior) / (r.c + 10), 6) AS route_encoded,
round((coalesce(b.s, 0) + 10 * prior) / (b.c + 10), 6) AS carrier_encoded
FROM cells x JOIN by_route r ON x.route = r.route AND x.fold = r.fold
JOIN by_carrier b ON x.carrier = b.carrier AND x.fold = b.fold JOIN g ON x.fold = g.fold""",
)
def target_encode_oof(spark, folder):
    df = with_features(_clean_trips(spark, folder)).withColumns(
        {"fold": F.pmod("l_orderkey", F.lit(5)), "carrier": F.col("OP_UNIQUE_CARRIER")}
    )
    encoded = E.TargetEncoder(["route", "carrier"]).fit_out_of_fold(df, TARGET, "fold")
    return encoded.groupBy("route", "carrier", "fold").agg(
        F.count("*").alias("n"),
        F.max("route_encoded").alias("route_encoded"),
        F.max("carrier_encoded").alias("carrier_encoded"),
    )


@query(
    "unseen_categories",
    f"""WITH {_EARLY}, late AS (SELECT * FROM ranked WHERE r > cut),
long AS (SELECT 'lane' AS feature, lane AS category FROM late UNION ALL SELECT 'ORIGIN', ORIGIN FROM late),
known AS (SELECT 'lane' AS feature, lane AS category FROM early UNION SELECT 'ORIGIN', ORIGIN FROM early)
SELECT feature, category, count(*) AS rows FROM long WHERE (feature, category) NOT IN (SELECT (feature, category) FROM known)
GROUP BY ALL""",
)
def unseen_categories(spark, folder):
    parts = _early_and_late(spark, folder)
    early, late = (parts.where(F.col("split") == name) for name in ("early", "late"))
    return E.unseen_categories(early, late, ["lane", "ORIGIN"])


@query(
    "one_hot",
    f"""WITH {_EARLY}, slots AS (
 SELECT 'lane' AS feature, lane AS category, row_number() OVER (ORDER BY lane) - 1 AS slot
 FROM (SELECT DISTINCT lane FROM early)
 UNION ALL SELECT 'ORIGIN', ORIGIN, row_number() OVER (ORDER BY ORIGIN) - 1 FROM (SELECT DISTINCT ORIGIN FROM early)),
used AS (SELECT 'lane' AS feature, lane AS category, count(*) AS n FROM ranked GROUP BY ALL
 UNION ALL SELECT 'ORIGIN', ORIGIN, count(*) FROM ranked GROUP BY ALL)
SELECT s.feature, s.slot, coalesce(u.n, 0) AS rows_hot FROM slots s LEFT JOIN used u
ON s.feature = u.feature AND s.category = u.category""",
)
def one_hot(spark, folder):
    df = _early_and_late(spark, folder).select("split", "lane", "ORIGIN")
    columns = ["lane", "ORIGIN"]
    slots = E.one_hot_slots(df.where("split = 'early'"), columns)
    hot = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__index").cast("int").alias("slot")) for c in columns]
    used = slots.transform(df).select(F.inline(F.array(*hot))).groupBy("feature", "slot").agg(F.count("*").alias("n"))
    return slots.slots.join(used, ["feature", "slot"], "left").select(
        "feature", "slot", F.coalesce("n", F.lit(0).cast("bigint")).alias("rows_hot")
    )


def _metric_sql(source: str, keys: str = "") -> str:
    shown = f"{keys}, " if keys else ""
    return f"""SELECT {shown}count(*) AS rows, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM {source} WHERE y IS NOT NULL GROUP BY ALL"""


_PAIRS = "pairs AS (SELECT *, ARR_DELAY AS y, predicted_arr_delay AS p FROM facts)"


@query("regression_metrics", f"WITH {FACTS}, {_PAIRS} {_metric_sql('pairs')}")
def regression_metrics(spark, folder):
    return M.regression_metrics(trip_facts(spark, folder))


_KEY_SQL = f"FL_DATE, {', '.join(KEYS)}, DISTANCE"


@query(
    "actual_against_predicted",
    f"""WITH {FACTS}, pairs AS (SELECT ARR_DELAY AS y, predicted_arr_delay AS p
 FROM (SELECT {_KEY_SQL}, ARR_DELAY FROM facts WHERE {USABLE}) a
 JOIN (SELECT {_KEY_SQL}, predicted_arr_delay FROM facts) b USING ({_KEY_SQL})) {_metric_sql('pairs')}""",
)
def actual_against_predicted(spark, folder):
    facts = trip_facts(spark, folder)
    key = ["FL_DATE", *RECORD_KEY]
    return M.regression_metrics(M.actual_against_predicted(usable_rows(facts), facts, key))


@query("metrics_by_carrier", f"WITH {FACTS}, {_PAIRS} {_metric_sql('pairs', 'OP_UNIQUE_CARRIER')}")
def metrics_by_carrier(spark, folder):
    return M.regression_metrics(trip_facts(spark, folder), ["OP_UNIQUE_CARRIER"])


@query(
    "metrics_by_split",
    f"""WITH {FACTS}, ranked AS (SELECT *, row_number() OVER (ORDER BY {RECORD_ORDER}) AS r, count(*) OVER () AS total FROM facts),
pairs AS (SELECT 'as_given' AS model, CASE WHEN r <= floor(total * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split,
 ARR_DELAY AS y, predicted_arr_delay AS p FROM ranked
 UNION ALL SELECT 'halved', CASE WHEN r <= floor(total * (1 - 0.2)) THEN 'train' ELSE 'test' END,
 ARR_DELAY, predicted_arr_delay * 0.5 FROM ranked),
m AS ({_metric_sql('pairs', 'model, split')})
SELECT model, {', '.join(f"max({n}) FILTER (split = '{s}') AS {s}_{n}" for s in ('train', 'test') for n in ('rows', 'rmse', 'mae', 'r2'))}
FROM m GROUP BY 1""",
)
def metrics_by_split(spark, folder):
    df = labelled_split(trip_facts(spark, folder), RECORD_KEY)
    candidates = F.array(
        F.struct(F.lit("as_given").alias("model"), F.col(PREDICTION).alias("p")),
        F.struct(F.lit("halved").alias("model"), (F.col(PREDICTION) * 0.5).alias("p")),
    )
    return M.metrics_table(df.select("split", TARGET, F.inline(candidates)), predicted="p")


@query(
    "score_python_model",
    f"WITH {TRIPS} SELECT {KEYS_SQL}, round_even(DISTANCE / 100, 2) AS predicted_arr_delay FROM trips",
)
def score_python_model(spark, folder):
    df = with_features(trips(spark, folder).drop(PREDICTION))
    return score_features(df, DistanceModel).select(*KEYS, PREDICTION)


_GOOD = " AND ".join(f"NOT ({test})" for _, test in _RULES.values())
_PASSED = [
    "FL_DATE",
    "OP_UNIQUE_CARRIER",
    "CRS_DEP_TIME",
    "CRS_ARR_TIME",
    "CRS_ELAPSED_TIME",
    "DISTANCE",
    "ORIGIN",
    "DEST",
    KEYS_SQL,
    "file_order",
]


@query(
    "score_passthrough",
    f"""WITH {TEXT} SELECT {', '.join(_PASSED)}, round_even(TRY_CAST(DISTANCE AS DOUBLE) / 100, 2) AS predicted_arr_delay
FROM text WHERE {_GOOD}""",
)
def score_passthrough(spark, folder):
    good, _ = quarantine(text_trips(trips(spark, folder)).drop(PREDICTION))
    return score_text(good, DistanceModel)


@query(
    "score_batch",
    f"""WITH {TEXT}, scored AS (SELECT ORIGIN, DEST, round_even(TRY_CAST(DISTANCE AS DOUBLE) / 100, 2) AS p
 FROM text WHERE {_GOOD})
SELECT concat(ORIGIN, ' → ', DEST) AS route, ORIGIN AS origin, DEST AS destination, round(avg(p), 6) AS avg_predicted_delay,
count(p) AS flights FROM scored GROUP BY ALL""",
)
def score_batch(spark, folder):
    good, _ = quarantine(text_trips(trips(spark, folder)).drop(PREDICTION))
    return A.by_route(score_text(good, DistanceModel))


@lru_cache(maxsize=2)
def _trained(session: str, spark, folder: str) -> tuple:
    """Stored metrics and importance of one fit, which both queries of a session share."""
    result = train(trips(spark, folder), SETTINGS)
    found = staged(result.metrics, "metrics"), staged(result.importance["boosted_trees"], "importance")
    result.close()
    return *found, result.trees["boosted_trees"]


@query("train_predict")
def train_predict(spark, folder):
    """Both models with the defaults; ``trees`` is how many rounds of the ceiling the validation rows asked for."""
    figures, _, trees = _trained(spark.sparkContext.applicationId, spark, folder)
    boosted = F.col("model") == "boosted_trees"
    return figures.select(
        "*", F.when(boosted, F.lit(trees)).alias("trees"), F.when(boosted, F.lit(SETTINGS.rounds)).alias("rounds"),
        F.when(boosted, F.lit(SETTINGS.depth)).alias("depth"),
    )


@query("feature_importance")
def feature_importance(spark, folder):
    _, importance, trees = _trained(spark.sparkContext.applicationId, spark, folder)
    return importance.withColumns({"trees": F.lit(trees), "rounds": F.lit(SETTINGS.rounds), "depth": F.lit(SETTINGS.depth)})


@query(
    "train_linear",
    f"""WITH {_FACT_SPLIT}, fitted AS (SELECT regr_slope(ARR_DELAY, DISTANCE) AS slope, regr_intercept(ARR_DELAY, DISTANCE) AS base
 FROM parts WHERE split = 'train')
SELECT split, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum, round(any_value(slope), 5) AS slope,
round(any_value(base), 4) AS intercept, round(sqrt(avg((ARR_DELAY - base - slope * DISTANCE) ** 2)), 4) AS rmse
FROM parts, fitted GROUP BY 1""",
)
def train_linear(spark, folder):
    """The parts of training, and a fit of one feature that a closed formula can check."""
    parts = labelled_split(clean(trip_facts(spark, folder)), RECORD_KEY).select("split", "l_orderkey", "DISTANCE", TARGET)
    parts = staged(parts, "parts")
    stages = modeling.encoded_preprocessor(["DISTANCE"])
    plain = LinearRegression(
        featuresCol=modeling.FEATURES, labelCol=TARGET, predictionCol=modeling.RAW_PREDICTION, solver="normal"
    )
    pipeline = modeling.fit(parts.where("split = 'train'"), stages, plain)
    line = pipeline.stages[-1]
    error = F.sqrt(F.avg((F.col(TARGET) - F.col(modeling.RAW_PREDICTION)) ** 2))
    return pipeline.transform(parts).groupBy("split").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"),
        F.lit(round(float(line.coefficients[0]), 5)).alias("slope"), F.lit(round(float(line.intercept), 4)).alias("intercept"),
        F.round(error, 4).alias("rmse"),
    )


@query(
    "fold_assignment",
    f"WITH {FACTS} SELECT count(*) AS rows, CAST(5 AS BIGINT) AS folds, TRUE AS balanced, TRUE AS stable FROM facts",
)
def fold_assignment(spark, folder):
    """Every record has one of five folds, of about equal size, whatever the partitioning."""
    facts = trip_facts(spark, folder).select(*RECORD_KEY)
    # Another partitioning, whose parts grow in number with the records; no part or supplier gathers in one task.
    dealt = facts.repartition(parts_by_size(facts, least=3), *RECORD_KEY)
    one, other = (df.groupBy(fold_of(RECORD_KEY, 5).alias("fold")).count() for df in (facts, dealt))
    both = one.join(other.withColumnRenamed("count", "again"), "fold")
    spare = 5 * F.sqrt(F.sum("count"))  # five standard deviations of a fair deal are less
    return both.agg(
        F.sum("count").alias("rows"), F.count("*").alias("folds"),
        (F.max("count") - F.min("count") <= spare).alias("balanced"), F.bool_and(F.col("count") == F.col("again")).alias("stable"),
    )
