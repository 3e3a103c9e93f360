"""The common input and output of all forecasters.

A *phase* says how many of the newest months are held back and how many months to forecast:
``val`` holds back the validation months and forecasts exactly those, ``future`` holds back
nothing. ``phase_frame`` lays the phases out as rows, so a model fits all series of all phases
in the same job. A panel is partitioned by series already; windows and aggregates by
(series, phase) keep that partitioning and add no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import months_after

KEYS = ["state", "phase"]
OF_FIT = "partition by state, phase"
FIT_ORDER = "partition by state, phase order by date"


@dataclass(frozen=True)
class Phase:
    name: str
    held_back: int
    steps: int


VALIDATION = Phase("val", 6, 6)
FUTURE = Phase("future", 0, 2)
PHASES = (VALIDATION, FUTURE)


def phase_frame(panel: DataFrame, phases: tuple[Phase, ...] = PHASES) -> DataFrame:
    """Panel rows per phase with ``at`` (0-based), ``n_fit``, ``steps`` and the flag ``fit``."""
    options = ", ".join(f"struct('{p.name}' as phase, {p.held_back} as held, {p.steps} as steps)" for p in phases)
    rows = panel.selectExpr("state", "date", "total", f"inline(array({options}))")
    placed = rows.selectExpr(
        "state",
        "phase",
        "date",
        "total",
        "steps",
        f"row_number() over ({FIT_ORDER}) - 1 as at",
        f"count(1) over ({OF_FIT}) - held as n_fit",
    )
    return placed.withColumn("fit", F.expr("at < n_fit"))


def _newest(column: str, k: int) -> Column:
    """The last k values of the fitted rows in time order; at most k rows are collected."""
    kept = f"collect_list(if(fit and at >= n_fit - {k}, struct(at, {column} as v), null))"
    return F.expr(f"transform(array_sort({kept}), r -> r.v) as {column}_tail")


def series_rows(frame: DataFrame, memory: dict[str, int], *extra: Column) -> DataFrame:
    """One row per series and phase: size, last fitted date, recent values, held-back actuals.

    ``memory`` maps a column to how many recent values are kept as the array ``<column>_tail``.
    """
    return (
        frame.groupBy(*KEYS)
        .agg(
            F.expr("cast(max(n_fit) as int) as n_fit"),
            F.expr("max(steps) as steps"),
            F.expr("max(if(fit, date, null)) as last_date"),
            F.expr(
                "transform(array_sort(collect_list(if(fit, null, struct(at, total as v)))), r -> r.v) as actuals"
            ),
            *[_newest(column, k) for column, k in memory.items()],
            *extra,
        )
        .filter("n_fit > 0")
    )


def as_predictions(
    rows: DataFrame, model: str | Column, yhat: Column | str = "yhat", error: Column | None = None
) -> DataFrame:
    """Long predictions out of an array of forecasts per series; negative forecasts become 0.

    With ``error``, a series that has such a text gets one row with it, in the column ``error``, and no forecast.
    """
    values = F.col(yhat) if isinstance(yhat, str) else yhat
    name = F.lit(model) if isinstance(model, str) else model
    told = []
    if error is not None:
        values = F.when(error.isNull(), values).otherwise(F.array(F.lit(None).cast("double")))
        told = [error.alias("error")]
    long = rows.select(
        "state", name.alias("model"), "phase", "last_date", "actuals", *told, F.posexplode(values).alias("at", "value")
    )
    return long.select(
        "state",
        "model",
        "phase",
        F.expr("at + 1 as step"),
        months_after("last_date", "at + 1").alias("date"),
        F.expr("if(error is null, greatest(value, 0D), null) as yhat" if told else "greatest(value, 0D) as yhat"),
        F.expr("try_element_at(actuals, at + 1) as y"),
        *(["error"] if told else []),
    )


def skipped(frame: DataFrame, model: str, least: int, reason: str) -> DataFrame:
    """Series too short for a model, as ``(state, phase, model, reason)``."""
    short = frame.groupBy(*KEYS).agg(F.max("n_fit").alias("n_fit")).filter(F.col("n_fit") < least)
    text = F.format_string(f"%d points, {reason} needs at least {least}", F.col("n_fit"))
    return short.select("state", "phase", F.lit(model).alias("model"), text.alias("reason"))
