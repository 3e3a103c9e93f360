"""The winning fit of every state in one typed table, from which forecasts are made without fitting again.

A row holds state, model, parameters and, in the struct column of its kind of fit, coefficients and recent values; the
other structs are NULL. The table is partitioned by kind, so a reader opens only the columns and files of the kinds that
it forecasts. Only models that won are fitted, per-series ones only on the states that they won; the pooled regression
is fitted on all series, as in the competition, and its few weights travel with the states it won.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.models import baselines, gbt_lag, seasonal_ar, seasonal_product, series_trees, trend_seasonal, window_huber
from seriesloom.models.frame import FUTURE, Phase, phase_frame
from seriesloom.models.registry import PARAMETERS, Settings
from seriesloom.session import materialize, union

ORDER = f"""map('order', concat('(', concat_ws(', ', best.{{0}}p, d, best.{{0}}q), ')'),
    'seasonal_order', concat('(', concat_ws(', ', best.{{0}}sp, best.{{0}}sd, best.{{0}}sq, {seasonal_ar.SEASON}), ')'),
    'aic', cast(best.aic as string))"""


@dataclass(frozen=True)
class Kind:
    """How a kind of fit is made and used: ``fit(frame, phases, **settings)``, ``predict(fits, **settings)``.

    ``own`` is the SQL text of the map of parameters that differ per series.
    """

    model: str
    fit: Callable[..., DataFrame]
    predict: Callable[..., DataFrame]
    own: str
    pooled: bool = False


def _pooled(frame: DataFrame, phases: tuple[Phase, ...], **settings) -> DataFrame:
    groups = window_huber.fit_groups(frame, phases, **settings)
    return union([window_huber.series_fits(window_huber.of_lookback(frame, m.numFeatures), phase, m) for phase, m in groups])


KINDS = {
    "seasonal_ar": Kind(
        seasonal_ar.NAME, lambda frame, phases, **s: seasonal_ar.fit(frame, **s), lambda fits, **s: seasonal_ar.predict(fits), ORDER.format("`order`.")
    ),
    "seasonal_product": Kind(
        seasonal_ar.NAME, lambda frame, phases, **s: seasonal_product.fit(frame, **s), lambda fits, **s: seasonal_product.predict(fits), ORDER.format("")
    ),
    "trend_seasonal": Kind(
        trend_seasonal.NAME, lambda frame, phases, **s: trend_seasonal.fit(frame, **s), trend_seasonal.predict, "map('slope', cast(get(coef, 1) as string))"
    ),
    "gbt_lag": Kind(
        gbt_lag.NAME, series_trees.fit, lambda fits, **s: series_trees.predict(fits, gbt_lag.NAME), "map('base', cast(base as string))"
    ),
    "window_huber": Kind(
        window_huber.NAME, _pooled, lambda fits, **s: window_huber.predict_series(fits),
        "map('intercept', cast(intercept as string), 'used_lookback', cast(size(weights) as string))", pooled=True,
    ),
    "seasonal_naive": Kind(
        baselines.SEASONAL_NAIVE, lambda frame, phases: baselines.naive_fits(frame), lambda fits, **s: baselines.predict_naive(fits), "map('season', '12')"
    ),
    "linear_trend": Kind(
        baselines.LINEAR_TREND, lambda frame, phases: baselines.line_fits(frame), lambda fits, **s: baselines.predict_line(fits),
        "map('slope', cast(slope as string), 'intercept', cast(intercept as string))",
    ),
}


def kind_of(model: str, settings: dict) -> tuple[str, dict]:
    """Kind of fit behind a model under its settings, and the settings that its fit takes."""
    rest = dict(settings)
    if model == seasonal_ar.NAME and rest.pop("product", False):
        return "seasonal_product", rest
    if model == gbt_lag.NAME and rest.pop("pooled", False):
        raise ValueError("pooled trees are no fit per series; save_fits keeps them")
    if model not in KINDS:
        raise ValueError(f"fits of {model!r} cannot be stored; known: {sorted(KINDS)}")
    return model, rest


def winning_fits(panel: DataFrame, records: DataFrame, settings: Settings | None = None, phase: Phase = FUTURE) -> DataFrame:
    """One row per state of ``records`` (state, best_model): the fit of its best model on all months of ``panel``.

    A state without a best model, or one that is not in the panel, has no row.
    """
    won = materialize(records.filter("best_model is not null").select("state", "best_model"))
    models = sorted(r.best_model for r in won.select("best_model").distinct().collect())  # as many as models
    kinds = {model: kind_of(model, (settings or {}).get(model, {})) for model in models}
    frame = materialize(phase_frame(panel.select("state", "date", "total"), (phase,)))
    parts = []
    for model, (name, given) in kinds.items():
        kind, mine = KINDS[name], won.filter(F.col("best_model") == model).select("state")
        rows = frame if kind.pooled else frame.join(mine, "state", "left_semi")
        fits = kind.fit(rows, (phase,), **given)
        if "error" in fits.columns:
            fits = fits.filter("error is null").drop("error")
        if kind.pooled:
            fits = fits.join(mine, "state", "left_semi")
        shared = PARAMETERS[model](**(settings or {}).get(model, {})) if model in PARAMETERS else {}
        known = F.create_map(*[F.lit(text) for pair in shared.items() for text in pair]).cast("map<string,string>")
        parts.append(
            fits.select(
                "state",
                F.lit(model).alias("model"),
                F.lit(json.dumps(given, sort_keys=True)).alias("settings"),
                F.map_concat(known, F.expr(kind.own)).alias("params"),
                F.lit(name).alias("kind"),
                F.struct(*[c for c in fits.columns if c != "state"]).alias(f"fit_{name}"),
            )
        )
    if not parts:
        raise ValueError("no state has a best model")
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part, allowMissingColumns=True)
    return made


def store_winners(panel: DataFrame, records: DataFrame, path: str, settings: Settings | None = None) -> None:
    """Write ``winning_fits`` as one Parquet table; an earlier one at the path is replaced."""
    winning_fits(panel, records, settings).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_winners(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def forecast_winners(stored: DataFrame, steps: int | None = None) -> DataFrame:
    """``(state, best_model, step, date, value)`` out of stored fits, for the stored number of steps or for ``steps``."""
    used = stored.select("kind", "settings").distinct().collect()  # kinds of fit times settings they were made with
    parts = []
    for kind, settings in sorted((r.kind, r.settings) for r in used):
        rows = stored.filter((F.col("kind") == kind) & (F.col("settings") == settings)).select("state", f"fit_{kind}.*")
        if steps is not None:
            rows = rows.withColumn("steps", F.lit(steps))
        if kind == "gbt_lag":
            rows = rows.withColumn("error", F.lit(None).cast("string"))
        made = KINDS[kind].predict(rows, **json.loads(settings))
        parts.append(made.select("state", F.col("model").alias("best_model"), "step", "date", F.col("yhat").alias("value")))
    if not parts:
        empty = "state string, best_model string, step int, date date, value double"
        return stored.sparkSession.createDataFrame([], empty)
    return union(parts)


def forecast_from_store(spark: SparkSession, path: str, steps: int | None = None) -> DataFrame:
    return forecast_winners(read_winners(spark, path), steps)
