"""Scoring with a Spark model or any Python object that has ``predict(frame)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import finite_number, hhmm_number, round_half_even
from ..schema import DATE, HHMM_COLUMNS, MEASURE_COLUMNS, MODEL_FEATURES, PREDICTION, TEXT_COLUMNS
from .features import model_frame, with_features
from .modeling import DelayModel
from .quality import PARSED_COLUMNS, parsed, parsed_name

ORIGINAL = "__original"


FIT = "__fit"


def typed_beside_text(df: DataFrame, fit: Column | None = None) -> DataFrame:
    """The raw columns with their types, the untouched input row kept in one struct.

    With ``fit``, the column of that name marks the rows for which it is true; the others get
    the same plain values, of which every feature can be built.
    """
    text = [c for c in df.columns if c not in PARSED_COLUMNS]
    if len(text) == len(df.columns):
        df = parsed(df)
    typed = df.select(
        *([] if fit is None else [fit.alias(FIT)]),
        F.struct(*(F.col(f"`{c}`") for c in text)).alias(ORIGINAL),
        F.col(parsed_name(DATE)).alias(DATE),
        *(hhmm_number(F.col(parsed_name(c)), "double").alias(c) for c in HHMM_COLUMNS),
        *(finite_number(F.col(parsed_name(c)), "double").alias(c) for c in MEASURE_COLUMNS),
        *(F.col(c).alias(c) for c in TEXT_COLUMNS),
    )
    if fit is None:
        return typed
    plain = {c: F.lit("1970-01-01" if c == DATE else "0").cast(kind) for c, kind in typed.drop(FIT, ORIGINAL).dtypes}
    return typed.withColumns({c: F.when(F.col(FIT), F.col(c)).otherwise(value) for c, value in plain.items()})


def python_prediction(
    load: Callable[[], object], features: Sequence[str] = MODEL_FEATURES, fit: Column | None = None
) -> Column:
    """Prediction column of a Python model; NULL where ``fit``, if given, is not true.

    Only the model features travel to Python, as Arrow batches, and the mark of the rows that
    are fit, if not all are; the model is loaded once per task and called once per batch.
    """

    def scores(model, frame: pd.DataFrame) -> np.ndarray:
        if len(absent := frame.columns[frame.isna().any()]):
            raise ValueError(f"Missing values in: {', '.join(absent)}")
        values = np.asarray(model.predict(frame), dtype=float)
        if len(values) != len(frame):
            raise ValueError("Prediction failed: wrong number of results.")
        return values

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for frame in batches:
            yield pd.Series(scores(model, frame))

    def predict_fit(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for frame, chosen in batches:
            values, chosen = np.full(len(frame), np.nan), chosen.to_numpy(dtype=bool)
            if chosen.any():
                values[chosen] = scores(model, frame if chosen.all() else frame[chosen].reset_index(drop=True))
            yield pd.Series(values)

    predict.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    predict_fit.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.Series]], "return": Iterator[pd.Series]}
    if fit is None:
        return round_half_even(F.pandas_udf(predict, "double")(F.struct(*features)))
    run = F.pandas_udf(predict_fit, "double")
    return F.when(fit, round_half_even(run(F.struct(*features), fit)))


def score_features(
    table: DataFrame, model, output: str = PREDICTION, features: Sequence[str] = MODEL_FEATURES,
    fit: Column | None = None,
) -> DataFrame:
    """Adds the rounded prediction. ``model``: a ``DelayModel`` or a function that loads a Python model.

    A Python model gets the columns ``features``, in that order; it fails on missing columns or values.
    Rows for which ``fit``, if given, is not true get NULL, and a Python model does not see them.
    """
    if isinstance(model, DelayModel):
        scored = model.transform(table, output)
        return scored if fit is None else scored.withColumn(output, F.when(fit, F.col(output)))
    return table.withColumn(output, python_prediction(model, model_frame(table, features).columns, fit))


def score_text(
    df: DataFrame, model, output: str = PREDICTION, features: Sequence[str] = MODEL_FEATURES, fit: Column | None = None
) -> DataFrame:
    """Text rows, unchanged and in their column order, plus the prediction.

    Expects rows that pass ``quality.scoring_rules``, or those for which ``fit`` is true; the others get NULL.
    """
    marked = None if fit is None else F.col(FIT)
    scored = score_features(with_features(typed_beside_text(df, fit)), model, output, features, marked)
    return scored.select(f"{ORIGINAL}.*", output)
