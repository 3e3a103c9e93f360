"""Models that are plain Python objects: one object per series, fitted inside Spark tasks.

A model class has ``fit(series)`` and ``predict(steps)``, and may have ``get_params()``; ``series`` is a pandas series of
totals at month ends. Spark gathers each series (as many rows as the calendar has months) in the partitioning the
frame has, and Arrow hands batches of whole series to the tasks; nothing is shuffled and no series meets another.

What an object raises, or a forecast that is not ``steps`` finite numbers, becomes the text of that series alone; all
others keep their results. The class travels to the executors by value, with what it uses of its module, unless it
belongs to an installed package, which executors must have too.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.frame import Phase, as_predictions, series_rows
from seriesloom.models.registry import MODELS, PARAMETERS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY = "transform(array_sort(collect_list(if(fit, struct(at, date, total), null))), r -> struct(r.date, r.total)) as history"
RESULT = "yhat array<double>, params map<string,string>, error string"


class SeriesModel(Protocol):
    """The three steps of a classic forecaster; ``get_params`` may be left out."""

    def fit(self, series: pd.Series) -> object: ...

    def predict(self, steps: int) -> object: ...

    def get_params(self) -> dict: ...


def _one(factory: Callable[..., SeriesModel], settings: dict, dates: list, totals: list, steps: int) -> tuple:
    """Forecasts, parameters and error text of one series; either the first two or the last."""
    try:
        model = factory(**settings)
        series = pd.Series(np.array(totals, float), index=pd.DatetimeIndex(dates))
        model.fit(series)
        values = np.asarray(model.predict(steps), dtype=float).ravel()
        if len(values) != steps or not np.isfinite(values).all():
            return None, None, f"{steps} finite numbers were asked for, the model gave {values.tolist()}"
        params = model.get_params() if hasattr(model, "get_params") else {}
        return values.tolist(), {str(k): str(v) for k, v in params.items()}, None
    except Exception as error:  # one series must not stop the others
        return None, None, f"{type(error).__name__}: {error}"


def _packed(factory: Callable[..., SeriesModel]) -> bytes:
    """The class as bytes that executors can read without having its module."""
    module = sys.modules.get(getattr(factory, "__module__", None) or "")
    installed = "site-packages" in (getattr(module, "__file__", None) or "")
    if module is None or installed or module.__name__ in cloudpickle.list_registry_pickle_by_value():
        return cloudpickle.dumps(factory)
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(factory)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def fit_each(frame: DataFrame, factory: Callable[..., SeriesModel], **settings) -> DataFrame:
    """One row per series and phase with its forecasts ``yhat`` and ``params``, or the ``error`` that its object raised."""
    rows = series_rows(frame, {}, F.expr(HISTORY)).select("state", "phase", "steps", "last_date", "actuals", "history")

    packed = _packed(factory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factory = pickle.loads(packed)
        for batch in batches:
            made = []
            for history, steps in zip(batch.column(5).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made.append(_one(factory, settings, [h["date"] for h in history], [h["total"] for h in history], steps))
            kinds = [pa.list_(pa.float64()), pa.map_(pa.string(), pa.string()), pa.string()]
            arrays = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *arrays], [*batch.schema.names[:5], "yhat", "params", "error"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5])
    return rows.mapInArrow(run, f"{kept}, {RESULT}")


def forecast_each(name: str, factory: Callable[..., SeriesModel], frame: DataFrame, **settings) -> DataFrame:
    """Predictions of all series, and one row with the column ``error`` for each series whose object failed."""
    return as_predictions(fit_each(frame, factory, **settings), name, "yhat", F.col("error"))


def series_parameters(name: str, factory: Callable[..., SeriesModel], frame: DataFrame, **settings) -> DataFrame:
    """``(state, phase, model, params)``: what ``get_params`` gave for every fitted series."""
    made = fit_each(frame, factory, **settings).filter("error is null")
    return made.select("state", "phase", F.lit(name).alias("model"), "params")


def register_series_model(name: str, factory: Callable[..., SeriesModel], parameters: Callable[..., dict[str, str]] | None = None) -> None:
    """Let the class compete under ``name`` beside the other models; settings go to its constructor."""
    if name in MODELS:
        raise ValueError(f"a model named {name!r} exists")

    def model(frame: DataFrame, phases: tuple[Phase, ...], **settings) -> DataFrame:
        return forecast_each(name, factory, frame, **settings)

    MODELS[name] = model
    if parameters:
        PARAMETERS[name] = parameters
