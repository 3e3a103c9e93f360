"""Linear model with Huber loss on scaled lookback windows, pooled over series.

A series looks back over half its points, at most twelve. Series with the same lookback share
a model; a dense panel has one lookback, and there are never more than twelve.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.frame import FIT_ORDER, OF_FIT, Phase, as_predictions, series_rows, skipped
from seriesloom.operators.features import SCALE_FLOOR
from seriesloom.operators.panel import tail_split
from seriesloom.session import materialize, side_by_side, union

NAME = "window_huber"
LOOKBACK = 12
LEAST = 4
EPSILON = 1.35
MAX_ITERATIONS = 100
TOLERANCE = 1e-6
PENALTY = 1e-4
#: Penalties that a training steered by its hold-out tries.
PATH = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)


LOOKBACK_OF_SERIES = f"least({LOOKBACK}, cast(n_fit div 2 as int))"


def lookbacks(frame: DataFrame) -> dict[str, list[int]]:
    """The lookbacks in use per phase; a handful of numbers."""
    used = frame.filter(f"n_fit >= {LEAST}").groupBy("phase")
    rows = used.agg(F.expr(f"array_sort(collect_set({LOOKBACK_OF_SERIES})) as lookbacks")).collect()
    return {row.phase: list(row.lookbacks) for row in rows}


def training_rows(frame: DataFrame, phase: str, lookback: int = LOOKBACK) -> DataFrame:
    """``(state, date, features, label)``; series with no full window give no rows."""
    rows = frame.filter((F.col("phase") == phase) & F.col("fit"))
    lo, hi = f"min(total) over ({OF_FIT})", f"max(total) over ({OF_FIT})"
    scaled = rows.selectExpr("state", "phase", "date", f"(total - {lo}) / ({hi} - {lo} + {SCALE_FLOOR}D) as label")
    previous = f"({FIT_ORDER} rows between {lookback} preceding and 1 preceding)"
    windowed = scaled.selectExpr("*", f"collect_list(label) over {previous} as x")
    return windowed.filter(F.size("x") == lookback).select(
        "state", "date", array_to_vector("x").alias("features"), "label"
    )


def fit(
    frame: DataFrame,
    phase: str,
    lookback: int = LOOKBACK,
    epsilon: float = EPSILON,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    penalty: float = PENALTY,
    penalties: tuple[float, ...] | None = None,
) -> LinearRegressionModel:
    """``penalties`` are tried on the inner part of every series; the best one on its tail is fitted again on all rows."""
    rows = materialize(training_rows(frame, phase, lookback))
    limits = {"epsilon": epsilon, "max_iterations": max_iterations, "tolerance": tolerance}
    if penalties:
        penalty = chosen(penalty_errors(rows, penalties, **limits), penalty)
    return _regression(penalty=penalty, **limits).fit(rows)


def _regression(epsilon: float, max_iterations: int, tolerance: float, penalty: float) -> LinearRegression:
    return LinearRegression(loss="huber", epsilon=epsilon, maxIter=max_iterations, tol=tolerance, regParam=penalty)


def penalty_errors(
    rows: DataFrame,
    penalties: tuple[float, ...],
    epsilon: float = EPSILON,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> list[tuple[float, int, float | None]]:
    """(penalty, rows held out, mean absolute error on them) of models fitted on the inner rows only.

    The newest fifth of the windows of every series is held out. The fits are independent jobs, submitted side by
    side; every error is one aggregate. Without any inner row there is nothing to choose by, and no error.
    """
    parts = materialize(tail_split(rows))
    inner, tail = parts.filter("part = 'train'"), parts.filter("part <> 'train'")
    if inner.isEmpty():
        return [(penalty, 0, None) for penalty in penalties]

    def judged(penalty: float) -> tuple[float, int, float | None]:
        model = _regression(epsilon, max_iterations, tolerance, penalty).fit(inner)
        found = model.transform(tail).agg(F.count("label").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("error")).first()
        return penalty, found.n, found.error

    return side_by_side([lambda p=p: judged(p) for p in penalties])


def chosen(errors: list[tuple[float, int, float | None]], otherwise: float) -> float:
    """The penalty of the lowest error, the stronger one on a tie."""
    known = [(error, -penalty) for penalty, _, error in errors if error is not None]
    return -min(known)[1] if known else otherwise


def penalty_path(frame: DataFrame, phases: tuple[Phase, ...], penalties: tuple[float, ...] = PATH, **settings) -> DataFrame:
    """``(phase, lookback, penalty, n_held_out, error, chosen)``: as many rows as groups of models times penalties."""
    found = []
    for phase, lookback in _groups(frame, phases):
        errors = penalty_errors(materialize(training_rows(of_lookback(frame, lookback), phase.name, lookback)), penalties, **settings)
        best = chosen(errors, PENALTY)
        found += [(phase.name, lookback, float(p), n, e, p == best) for p, n, e in errors]
    schema = "phase string, lookback int, penalty double, n_held_out long, error double, chosen boolean"
    return frame.sparkSession.createDataFrame(found, schema)


def series_fits(frame: DataFrame, phase: Phase, model: LinearRegressionModel) -> DataFrame:
    """One row per series with all that its forecasts need: recent values, scale, weights; it can be stored."""
    lookback = model.numFeatures
    lo, hi = "min(if(fit, total, null))", "max(if(fit, total, null))"
    rows = series_rows(
        frame.filter(F.col("phase") == phase.name),
        {"total": lookback},
        F.expr(f"{lo} as lo"),
        F.expr(f"{hi} - {lo} + {SCALE_FLOOR}D as rng"),
    ).filter(f"n_fit > {lookback}")
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()]).alias("weights")
    return rows.select("*", weights, F.lit(float(model.intercept)).alias("intercept"))


def predict_series(fits: DataFrame) -> DataFrame:
    """Fold the steps over the scaled window of each series; one row per series, no shuffle per step."""
    window = "slice(z, -size(weights), size(weights))"
    value = f"aggregate(zip_with(weights, {window}, (w, x) -> w * x), 0D, (sum, x) -> sum + x) + intercept"
    path = f"""aggregate(
        sequence(1, steps),
        transform(total_tail, x -> (x - lo) / rng),
        (z, s) -> array_append(z, {value}),
        z -> transform(slice(z, -steps, steps), v -> v * rng + lo))"""
    return as_predictions(fits, NAME, F.expr(path))


def predict(frame: DataFrame, phase: Phase, model: LinearRegressionModel) -> DataFrame:
    return predict_series(series_fits(frame, phase, model))


def _groups(frame: DataFrame, phases: tuple[Phase, ...]) -> list[tuple[Phase, int]]:
    used = lookbacks(frame)
    return [(phase, lookback) for phase in phases for lookback in used.get(phase.name, [])]


def fit_groups(frame: DataFrame, phases: tuple[Phase, ...], **settings) -> list[tuple[Phase, LinearRegressionModel]]:
    """One model per phase and lookback. The fits are independent jobs, submitted side by side."""
    groups = _groups(frame, phases)
    if not groups:
        raise ValueError(f"no series has {LEAST} points")
    models = side_by_side([lambda g=g: fit(of_lookback(frame, g[1]), g[0].name, g[1], **settings) for g in groups])
    return [(phase, model) for (phase, _), model in zip(groups, models)]


def of_lookback(frame: DataFrame, lookback: int) -> DataFrame:
    return frame.filter(f"n_fit >= {LEAST} and {LOOKBACK_OF_SERIES} = {lookback}")


def forecast(frame: DataFrame, phases: tuple[Phase, ...], **settings) -> DataFrame:
    """``settings``: epsilon, max_iterations, tolerance, penalty and penalties of ``fit``."""
    groups = fit_groups(frame, phases, **settings)
    return union([predict(of_lookback(frame, model.numFeatures), phase, model) for phase, model in groups])


def skipped_series(frame: DataFrame) -> DataFrame:
    return skipped(frame, NAME, LEAST, "a lookback window")


def parameters(**settings) -> dict[str, str]:
    known = {"lookback": LOOKBACK, "epsilon": EPSILON, "max_iterations": MAX_ITERATIONS, "tolerance": TOLERANCE, "penalty": PENALTY}
    return {name: str(value) for name, value in (known | settings).items()}
