"""Trend with change points, yearly seasonality and a holiday effect, multiplicative.

Fits ``log(1 + total / mean)`` by ridge regression on hinge, Fourier and holiday columns. This
is a penalised linear model, not a Bayesian one: the change-point prior acts as a penalty.

With ``sparse``, hinges get an absolute penalty by coordinate descent instead, so that most change points end at exactly
0 and ``trend_changes`` lists the others. With ``named_holidays``, every holiday has a column of its own with its days in
the month. In monthly data a holiday that always has as many days is hard to tell from its month; the penalty
shares the effect between both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import HOLIDAY_NAMES, fourier_pairs, holiday_days, is_holiday_month, months_after
from seriesloom.models.frame import KEYS, OF_FIT, series_rows, skipped
from seriesloom.models.least_squares import design_rows, dot, penalised_solutions

NAME = "trend_seasonal"
CHANGE_RANGE = 0.8
LEAST = 15


@dataclass(frozen=True)
class Shape:
    """Change points, Fourier orders and penalties; six orders are what monthly data can carry."""

    change_points: int = 25
    fourier_order: int = 6
    changepoint_prior: float = 0.05
    seasonal_penalty: float = 0.1
    sparse: bool = False
    named_holidays: bool = False

    @property
    def trend(self) -> range:
        return range(0, 2 + self.change_points)

    @property
    def seasonal(self) -> range:
        return range(self.trend.stop, self.trend.stop + 2 * self.fourier_order)

    @property
    def holiday(self) -> range:
        return range(self.seasonal.stop, self.seasonal.stop + (len(HOLIDAY_NAMES) if self.named_holidays else 1))

    @property
    def hinges(self) -> range:
        return range(2, self.trend.stop)

    @property
    def knots(self) -> list[float]:
        """Places of the change points in time that runs 0..1 over the fitted rows."""
        return [CHANGE_RANGE * (i + 1) / self.change_points for i in range(self.change_points)]

    @property
    def sparse_weight(self) -> float:
        """1 at the default prior; a smaller prior wants stronger evidence for a change."""
        return 0.05 / self.changepoint_prior

    @property
    def penalties(self) -> list[float]:
        hinge = 1.0 / (self.changepoint_prior * 100)
        return [0.0, 0.0] + [hinge] * self.change_points + [self.seasonal_penalty] * (len(self.seasonal) + len(self.holiday))


def with_design(rows: DataFrame, at: str, shape: Shape = Shape()) -> DataFrame:
    """Columns x0..: intercept, slope, hinges, Fourier pairs, holiday flag.

    Needs ``date`` and ``n_fit``; time runs 0..1 over the fitted rows.
    """
    timed = rows.withColumn("time", F.expr(f"({at}) / greatest(n_fit - 1, 1)"))
    hinges = [F.expr(f"greatest(time - {knot!r}D, 0D)") for knot in shape.knots]
    seasonal = list(fourier_pairs("date", shape.fourier_order).values())
    holidays = holiday_days("date").values() if shape.named_holidays else [is_holiday_month("date")]
    columns = [F.lit(1.0), F.col("time"), *hinges, *seasonal, *[days.cast("double") for days in holidays]]
    return timed.select("*", *[column.alias(f"x{i}") for i, column in enumerate(columns)]).drop("time")


def piece(part: range) -> str:
    """SQL text of one part of the fitted value, on the log scale."""
    return dot(f"slice(coef, {part.start + 1}, {len(part)})", [f"x{i}" for i in part])


def history(frame: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Design columns, scale and target of every row of a phase frame."""
    scaled = frame.withColumn("scale", F.expr(f"greatest(avg(if(fit, total, null)) over ({OF_FIT}), 1e-9D)"))
    return with_design(scaled, "at", shape).withColumn("target", F.expr("log1p(greatest(total, 0D) / scale)"))


def fit(frame: DataFrame, keep_rows: bool = False, keep_failed: bool = False, **settings) -> DataFrame:
    """One row per series and phase with ``coef`` and ``scale``; with its fitted ``rows`` if asked.

    ``settings`` are the fields of ``Shape``. With ``keep_failed``, series without a solution stay, with the reason as ``error``.
    """
    shape = Shape(**settings)
    names = [f"x{i}" for i in range(shape.holiday.stop)]
    wanted = [design_rows(names, "target", "fit", "designs"), F.expr("max(scale) as scale")]
    if keep_rows:
        wanted.append(F.expr("collect_list(if(fit, struct(at, date, total), null)) as rows"))
    rows = series_rows(history(frame, shape), {}, *wanted).filter(f"n_fit >= {LEAST}")
    hinges = list(shape.hinges) if shape.sparse else None
    made = penalised_solutions(F.col("designs"), shape.penalties, hinges, shape.sparse_weight)
    solved = rows.withColumn("solved", made).drop("designs")
    solved = solved.select(*[c for c in solved.columns if c != "solved"], "solved.coef", "solved.error")
    return solved if keep_failed else solved.filter("coef is not null").drop("error")


def forecast(frame: DataFrame, **settings) -> DataFrame:
    return predict(fit(frame, keep_failed=True, **settings), **settings)


def predict(fits: DataFrame, **settings) -> DataFrame:
    """Forecasts out of a table of fits, fresh or stored, made with the same settings."""
    shape = Shape(**settings)
    told = "error" in fits.columns
    made = fits.selectExpr("*", f"explode({'if(error is null, sequence(1, steps), array(0))' if told else 'sequence(1, steps)'}) as step")
    dated = with_design(made.withColumn("date", months_after("last_date", "step")), "n_fit - 1 + step", shape)
    return dated.selectExpr(
        "state",
        f"'{NAME}' as model",
        "phase",
        "step",
        "date",
        f"greatest(scale * expm1({piece(shape.trend)} + {piece(shape.seasonal)} + {piece(shape.holiday)}), 0D) as yhat",
        "try_element_at(actuals, nullif(step, 0)) as y",
        *(["error"] if told else []),
    )


def components(frame: DataFrame, **settings) -> DataFrame:
    """Trend, seasonal and holiday parts (log scale) and the fitted value of every fitted row."""
    shape = Shape(**settings)
    rows = fit(frame, keep_rows=True, **settings).selectExpr(*KEYS, "n_fit", "scale", "coef", "inline(rows)")
    parts = with_design(rows, "at", shape).selectExpr(
        *KEYS,
        "date",
        "total",
        "scale",
        f"{piece(shape.trend)} as trend",
        f"{piece(shape.seasonal)} as seasonal",
        f"{piece(shape.holiday)} as holiday",
    )
    return parts.withColumn("yhat", F.expr("scale * expm1(trend + seasonal + holiday)")).drop("scale")


def trend_changes(frame: DataFrame, **settings) -> DataFrame:
    """Change points that are not 0, per series and phase: first month after it, change of the slope per month (log scale).

    Hinges are sparse unless ``settings`` say otherwise.
    """
    settings = {"sparse": True} | settings
    shape = Shape(**settings)
    points = ", ".join(f"struct({knot!r}D as knot, get(coef, {i}) as weight)" for knot, i in zip(shape.knots, shape.hinges))
    rows = fit(frame, **settings).selectExpr(*KEYS, "n_fit", "last_date", f"inline(array({points}))").filter("weight <> 0")
    after = "cast(floor(knot * (n_fit - 1)) as int) + 1 - (n_fit - 1)"
    return rows.select(*KEYS, months_after("last_date", after).alias("date"), F.expr("weight / greatest(n_fit - 1, 1) as slope_change"))


def holiday_effects(frame: DataFrame, **settings) -> DataFrame:
    """Effect of one day of each holiday (log scale), per series and phase and by name."""
    settings = {"named_holidays": True} | settings
    shape = Shape(**settings)
    names = HOLIDAY_NAMES if shape.named_holidays else ["any holiday"]
    effects = ", ".join(f"struct({_text(name)} as holiday, get(coef, {i}) as effect)" for name, i in zip(names, shape.holiday))
    return fit(frame, **settings).selectExpr(*KEYS, f"inline(array({effects}))")


def _text(name: str) -> str:
    return "'" + name.replace("'", "\\'") + "'"


def skipped_series(frame: DataFrame) -> DataFrame:
    return skipped(frame, NAME, LEAST, "a trend with seasonality")


def parameters(**settings) -> dict[str, str]:
    shape = Shape(**settings)
    return {
        "changepoint_prior": str(shape.changepoint_prior),
        "change_points": str(shape.change_points),
        "yearly_seasonality": str(shape.fourier_order),
        "add_holidays": "true",
        "sparse": str(shape.sparse).lower(),
        "named_holidays": str(shape.named_holidays).lower(),
    }
