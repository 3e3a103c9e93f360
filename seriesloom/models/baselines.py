"""Two forecasters that are plain aggregates: last year's value, and a straight line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.models.frame import as_predictions, series_rows, skipped

SEASON = 12
SEASONAL_NAIVE = "seasonal_naive"
LINEAR_TREND = "linear_trend"

REPEAT_SEASON = f"""if(size(total_tail) = {SEASON},
    transform(sequence(1, steps), s -> element_at(total_tail, pmod(s - 1, {SEASON}) + 1)), null)"""
EXTEND_LINE = """if(slope is not null,
    transform(sequence(1, steps), s -> intercept + slope * (n_fit - 1 + s)), null)"""


def _line() -> list[Column]:
    fitted, at = "if(fit, total, null)", "cast(at as double)"
    return [F.expr(f"regr_slope({fitted}, {at}) as slope"), F.expr(f"regr_intercept({fitted}, {at}) as intercept")]


def naive_fits(frame: DataFrame) -> DataFrame:
    """One row per series with its last year."""
    return series_rows(frame, {"total": SEASON})


def predict_naive(fits: DataFrame) -> DataFrame:
    return as_predictions(fits, SEASONAL_NAIVE, F.expr(REPEAT_SEASON))


def seasonal_naive(frame: DataFrame) -> DataFrame:
    """The value of the same month one year earlier; needs one full year."""
    return predict_naive(naive_fits(frame))


def line_fits(frame: DataFrame) -> DataFrame:
    """One row per series with its slope and intercept."""
    return series_rows(frame, {}, *_line())


def predict_line(fits: DataFrame) -> DataFrame:
    return as_predictions(fits, LINEAR_TREND, F.expr(EXTEND_LINE))


def linear_trend(frame: DataFrame) -> DataFrame:
    """Least-squares line over the position in the series."""
    return predict_line(line_fits(frame))


def baseline_predictions(frame: DataFrame) -> DataFrame:
    """Both baselines out of one aggregate over the frame."""
    rows = series_rows(frame, {"total": SEASON}, *_line())
    made = rows.selectExpr(
        "*",
        f"""inline(array(struct('{SEASONAL_NAIVE}' as model, {REPEAT_SEASON} as yhat),
                         struct('{LINEAR_TREND}' as model, {EXTEND_LINE} as yhat)))""",
    )
    return as_predictions(made, F.col("model"), "yhat")


def skipped_naive(frame: DataFrame) -> DataFrame:
    return skipped(frame, SEASONAL_NAIVE, SEASON, "last year's value")


def skipped_trend(frame: DataFrame) -> DataFrame:
    return skipped(frame, LINEAR_TREND, 2, "a line")
