"""The competing models, in the order that breaks ties, and a facade over one of them.

A model is a function ``(phase frame, phases, **settings) -> predictions`` that covers every series.
Adding one is a call of ``register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.models import baselines, gbt_lag, seasonal_ar, seasonal_product, trend_seasonal, window_huber
from seriesloom.models.frame import PHASES, Phase, phase_frame

Model = Callable[..., DataFrame]
Settings = dict[str, dict]


def _seasonal(frame: DataFrame, phases: tuple[Phase, ...], product: bool = False, **settings) -> DataFrame:
    """With ``product``, lag polynomials are multiplied and fitted by Gauss-Newton instead of the two-stage estimate."""
    return (seasonal_product if product else seasonal_ar).forecast(frame, **settings)


def _seasonal_parameters(product: bool = False, **settings) -> dict[str, str]:
    return (seasonal_product if product else seasonal_ar).parameters(**settings)


MODELS: dict[str, Model] = {
    seasonal_ar.NAME: _seasonal,
    trend_seasonal.NAME: lambda frame, phases, **settings: trend_seasonal.forecast(frame, **settings),
    gbt_lag.NAME: gbt_lag.forecast,
    window_huber.NAME: window_huber.forecast,
    baselines.SEASONAL_NAIVE: lambda frame, phases: baselines.seasonal_naive(frame),
    baselines.LINEAR_TREND: lambda frame, phases: baselines.linear_trend(frame),
}

SKIPPED = {
    seasonal_ar.NAME: seasonal_ar.skipped_series,
    trend_seasonal.NAME: trend_seasonal.skipped_series,
    gbt_lag.NAME: gbt_lag.skipped_series,
    window_huber.NAME: window_huber.skipped_series,
    baselines.SEASONAL_NAIVE: baselines.skipped_naive,
    baselines.LINEAR_TREND: baselines.skipped_trend,
}

PARAMETERS = {
    seasonal_ar.NAME: _seasonal_parameters,
    trend_seasonal.NAME: trend_seasonal.parameters,
    gbt_lag.NAME: gbt_lag.parameters,
    window_huber.NAME: window_huber.parameters,
}

BASELINES = [baselines.SEASONAL_NAIVE, baselines.LINEAR_TREND]


def register(name: str, model: Model, parameters: Callable[..., dict[str, str]] | None = None) -> None:
    """Add a model; ``parameters`` turns its settings into a map of texts."""
    if name in MODELS:
        raise ValueError(f"a model named {name!r} exists")
    MODELS[name] = model
    if parameters:
        PARAMETERS[name] = parameters


def parameter_table(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """``(model, params)`` of the models that have parameters, under the given settings."""
    rows = [(name, make(**(settings or {}).get(name, {}))) for name, make in PARAMETERS.items()]
    return spark.createDataFrame(rows, "model string, params map<string,string>")


class Forecaster:
    """One model with the fit, predict and get_params steps of a classic forecaster."""

    def __init__(self, name: str, **settings):
        if name not in MODELS:
            raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
        self.name = name
        self.settings = settings
        self._panel: DataFrame | None = None

    def fit(self, panel: DataFrame) -> Forecaster:
        self._panel = panel
        return self

    def predict(self, steps: int) -> DataFrame:
        """Forecasts of every series of the fitted panel, ``steps`` months ahead."""
        if self._panel is None:
            raise RuntimeError("call fit before predict")
        phases = (Phase("future", 0, steps),)
        made = MODELS[self.name](phase_frame(self._panel, phases), phases, **self.settings)
        if "error" in made.columns:
            made = made.filter("error is null")
        return made.select("state", "step", "date", "yhat")

    def get_params(self) -> dict[str, str]:
        return PARAMETERS[self.name](**self.settings) if self.name in PARAMETERS else {}


__all__ = ["BASELINES", "MODELS", "PARAMETERS", "PHASES", "SKIPPED", "Forecaster", "parameter_table", "register"]
