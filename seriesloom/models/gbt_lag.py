"""Gradient-boosted trees on lag, rolling and calendar features.

``forecast`` grows the trees of every series on its own rows (``series_trees``), or with ``pooled=True`` one MLlib
model per phase on the rows of all series. The functions below are those of the pooled model: each series is scaled
to the range of its fitted rows, so one model serves series of any size.
The recursive forecast keeps the last 13 values of a series as an array and is a chain of
projections over one row per series: no shuffle, join or lineage cut per step.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import months_after
from seriesloom.models import series_trees
from seriesloom.models.frame import OF_FIT, Phase, as_predictions, series_rows, skipped
from seriesloom.operators.features import (
    SCALE_FLOOR,
    feature_names,
    features_from_history,
    model_features,
)
from seriesloom.session import materialize, side_by_side, union

NAME = "gbt_lag"
MEMORY = 13
LEAST = MEMORY
MAX_ITERATIONS = 300

# Tree settings. The number of trees is ``max_iterations``.
TREE_SETTINGS = {
    "maxDepth": 4,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}


def _scaled(columns: dict[str, str]) -> list[Column]:
    """Features relative to the range of the series; calendar and growth stay as they are."""
    made = []
    for name, text in columns.items():
        if name.startswith(("lag_", "rolling_mean_")):
            text = f"(({text}) - lo) / rng"
        elif name.startswith("rolling_std_"):
            text = f"({text}) / rng"
        made.append(F.expr(f"cast({text} as double) as {name}"))
    return made


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=feature_names(), outputCol="features")


def training_rows(frame: DataFrame, phase: str) -> DataFrame:
    """``(state, date, features, label)`` of the fitted rows of a phase."""
    rows = frame.filter((F.col("phase") == phase) & F.col("fit"))
    lo, hi = f"min(total) over ({OF_FIT})", f"max(total) over ({OF_FIT})"
    ranged = rows.selectExpr("state", "date", "total", f"{lo} as lo", f"{hi} - {lo} + {SCALE_FLOOR}D as rng")
    wide = model_features(ranged, known_growth_only=True, keep=["lo", "rng"])
    scaled = wide.select(
        "state", "date", *_scaled({name: name for name in feature_names()}), F.expr("(sales - lo) / rng as label")
    )
    return _assembler().transform(scaled).select("state", "date", "features", "label")


def fit(frame: DataFrame, phase: str, max_iterations: int = MAX_ITERATIONS, **settings) -> GBTRegressionModel:
    """One pooled model. The training rows are computed once: boosting reads them repeatedly.

    ``settings`` override ``TREE_SETTINGS``. The rows keep the partitioning by series of the panel.
    """
    rows = materialize(training_rows(frame, phase))
    return GBTRegressor(maxIter=max_iterations, **(TREE_SETTINGS | settings)).fit(rows)


def predict(frame: DataFrame, phase: Phase, model: GBTRegressionModel) -> DataFrame:
    """Walk forward: every forecast joins the history that the next step sees."""
    lo, hi = "min(if(fit, total, null))", "max(if(fit, total, null))"
    rows = series_rows(
        frame.filter(F.col("phase") == phase.name),
        {"total": MEMORY},
        F.expr(f"{lo} as lo"),
        F.expr(f"{hi} - {lo} + {SCALE_FLOOR}D as rng"),
    ).filter(f"n_fit >= {LEAST}")
    rows = rows.withColumnRenamed("total_tail", "history").withColumn("path", F.expr("cast(array() as array<double>)"))
    kept = rows.columns
    assembler = _assembler()
    for step in range(1, phase.steps + 1):
        dated = rows.withColumn("next_date", months_after("last_date", step))
        features = features_from_history("history", "next_date", f"n_fit + {step - 1}", known_growth_only=True)
        scored = model.transform(assembler.transform(dated.select(*kept, *_scaled(features))))
        valued = scored.selectExpr(*kept, "greatest(prediction * rng + lo, 0D) as value")
        rows = valued.selectExpr(
            *[name for name in kept if name not in ("history", "path")],
            f"array_append(slice(history, 2, {MEMORY - 1}), value) as history",
            "array_append(path, value) as path",
        )
    return as_predictions(rows, NAME, "path")


def fit_phases(frame: DataFrame, phases: tuple[Phase, ...], **settings) -> list:
    """One model per phase. The fits are independent jobs and are submitted side by side."""
    return side_by_side([lambda p=p: fit(frame, p.name, **settings) for p in phases])


def forecast(frame: DataFrame, phases: tuple[Phase, ...], pooled: bool = False, **settings) -> DataFrame:
    """``settings``: those of ``series_trees.Growth``; of the pooled model ``max_iterations`` and ``TREE_SETTINGS``."""
    if not pooled:
        return series_trees.predict(series_trees.fit(frame, phases, **settings), NAME)
    models = fit_phases(frame, phases, **settings)
    return union([predict(frame, phase, model) for phase, model in zip(phases, models)])


def feature_importance(model: GBTRegressionModel, frame: DataFrame) -> DataFrame:
    """Importance per feature name, largest first; as many rows as features."""
    pairs = list(zip(feature_names(), map(float, model.featureImportances.toArray())))
    table = frame.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def save(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def skipped_series(frame: DataFrame) -> DataFrame:
    return skipped(frame, NAME, LEAST, "a lag model")


def parameters(pooled: bool = False, max_iterations: int = MAX_ITERATIONS, **settings) -> dict[str, str]:
    if not pooled:
        return series_trees.parameters(max_iterations=max_iterations, **settings)
    return {"max_iterations": str(max_iterations), **{k: str(v) for k, v in (TREE_SETTINGS | settings).items()}}
