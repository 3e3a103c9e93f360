"""Lag, rolling, calendar and growth features; scaling; lookback sequences.

All window expressions share one specification, so a feature table costs one shuffle and one
sort by series and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import is_holiday_month, month_angle, months_after
from seriesloom.operators.panel import IN_TIME, by_series, in_time

LAGS = [1, 2, 3, 6, 12]
WINDOWS = [3, 6, 12]
CALENDAR = ["month", "quarter", "year", "trend", "sin_month", "cos_month"]
SCALE_FLOOR = 1e-8


def lag_columns(lags: list[int], value: str = "sales") -> dict[str, str]:
    return {f"lag_{k}": f"lag({value}, {k}) over ({IN_TIME})" for k in lags}


def rolling_columns(windows: list[int], value: str = "sales") -> dict[str, str]:
    """Mean and sample deviation of the previous k rows; NULL until k rows precede."""
    columns: dict[str, str] = {}
    for k in windows:
        frame = f"({IN_TIME} rows between {k} preceding and 1 preceding)"
        for kind, function in (("mean", "avg"), ("std", "stddev_samp")):
            columns[f"rolling_{kind}_{k}"] = (
                f"if(count({value}) over {frame} = {k}, {function}({value}) over {frame}, null)"
            )
    return columns


def date_columns(date: str, trend: str) -> dict[str, str]:
    return {
        "month": f"month({date})",
        "quarter": f"quarter({date})",
        "year": f"year({date})",
        "trend": f"cast({trend} as int)",
        "sin_month": f"sin({month_angle(date)})",
        "cos_month": f"cos({month_angle(date)})",
    }


def growth(now: str, then: str) -> str:
    """Relative change; missing when the base is missing or 0."""
    return f"(try_divide({now}, {then}) - 1)"


TREND = f"row_number() over ({IN_TIME}) - 1"


def build_features(panel: DataFrame, lags: list[int] | None = None, windows: list[int] | None = None) -> DataFrame:
    """Full feature table; rows whose features need more history than there is are kept."""
    series = panel.select("state", "date", F.col("total").alias("sales"))
    columns = {**lag_columns(lags or LAGS), **rolling_columns(windows or WINDOWS), **date_columns("date", TREND)}
    growing = growth("sales", f"lag(sales, 12) over ({IN_TIME})")
    return series.select(
        "*",
        *_named(columns),
        is_holiday_month("date").alias("holiday_month"),
        F.expr(growing).alias("yoy_growth"),
    )


def model_features(
    panel: DataFrame,
    lags: list[int] | None = None,
    windows: list[int] | None = None,
    known_growth_only: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Feature table for lag models: no holiday flag, missing deviation and growth are 0.

    Yearly growth compares the current value, which a forecaster cannot know. With
    ``known_growth_only`` it compares the previous value with the one a year before it.
    """
    lags, windows = lags or LAGS, windows or WINDOWS
    series = panel.select("state", "date", F.col("total").alias("sales"), *(keep or []))
    now, base = ("lag(sales, 1) over ({0})", "lag(sales, 13) over ({0})") if known_growth_only else ("sales", "lag(sales, 12) over ({0})")
    rolled = {
        name: f"coalesce({text}, 0D)" if "_std_" in name else text for name, text in rolling_columns(windows).items()
    }
    columns = {
        **lag_columns(lags),
        **rolled,
        **date_columns("date", TREND),
        "yoy_growth": f"coalesce({growth(now.format(IN_TIME), base.format(IN_TIME))}, 0D)",
    }
    return series.select("*", *_named(columns)).na.drop()


def feature_names(lags: list[int] | None = None, windows: list[int] | None = None) -> list[str]:
    rolled = [f"rolling_{kind}_{k}" for k in (windows or WINDOWS) for kind in ("mean", "std")]
    return [f"lag_{k}" for k in (lags or LAGS)] + rolled + CALENDAR + ["yoy_growth"]


def prepare_supervised(features: DataFrame) -> DataFrame:
    """Rows where every feature is present."""
    return features.na.drop()


def features_from_history(
    history: str,
    date: str,
    trend: str,
    lags: list[int] | None = None,
    windows: list[int] | None = None,
    known_growth_only: bool = False,
) -> dict[str, str]:
    """The ``model_features`` of the row that follows ``history``, an array of past values.

    Built from array expressions, so a recursive forecast is a chain of projections.
    The unknown current value is taken to repeat the last one.
    """
    columns = {f"lag_{k}": f"element_at({history}, -{k})" for k in lags or LAGS}
    for k in windows or WINDOWS:
        recent = f"slice({history}, -{k}, {k})"
        total = f"aggregate({recent}, 0D, (acc, x) -> acc + x)"
        columns[f"rolling_mean_{k}"] = f"({total} / {k})"
        # the mean travels in the accumulator, so it is worked out once
        columns[f"rolling_std_{k}"] = f"""aggregate({recent}, struct({total} / {k} as mean, 0D as squares),
            (acc, x) -> struct(acc.mean as mean, acc.squares + (x - acc.mean) * (x - acc.mean) as squares),
            acc -> sqrt(acc.squares / {k - 1}))"""
    columns.update(date_columns(date, trend))
    base = f"try_element_at({history}, {-13 if known_growth_only else -12})"
    columns["yoy_growth"] = f"coalesce({growth(f'element_at({history}, -1)', base)}, 0D)"
    return columns


def next_step_features(panel: DataFrame) -> DataFrame:
    """Features of the first month after each series, from its last 13 rows."""
    memory = series_memory(panel, 13).filter(F.size("history") >= 12)
    dated = memory.withColumn("date", months_after("last_date", 1))
    return dated.select("state", "date", *_named(features_from_history("history", "date", "n")))


def series_memory(panel: DataFrame, k: int) -> DataFrame:
    """One row per series: size, last date and the last k totals in time order."""
    size = F.count(F.lit(1)).over(by_series())
    at = F.row_number().over(in_time())
    recent = F.when(F.col("at") > F.col("n") - k, F.struct("at", "total"))
    rows = panel.select("state", "date", "total", at.alias("at"), size.alias("n"))
    memory = rows.groupBy("state").agg(
        F.max("n").cast("int").alias("n"),
        F.max("date").alias("last_date"),
        F.array_sort(F.collect_list(recent)).alias("recent"),
    )
    return memory.select("state", "n", "last_date", F.col("recent.total").alias("history"))


def min_max_scale(split: DataFrame) -> DataFrame:
    """Scaled value ``z`` with the range of the training rows only, plus that range."""
    known = F.when(F.col("split") == "train", F.col("total"))
    lo, hi = F.min(known).over(by_series()), F.max(known).over(by_series())
    ranged = split.withColumns({"lo": lo, "rng": hi - lo + SCALE_FLOOR})
    return ranged.withColumn("z", (F.col("total") - F.col("lo")) / F.col("rng"))


def inverse_scale(z: Column, lo: Column, rng: Column) -> Column:
    return z * rng + lo


def make_sequences(df: DataFrame, lookback: int = 12, value: str = "z") -> DataFrame:
    """Per row the previous ``lookback`` values as an array ``x`` and its own value as ``y``."""
    frame = in_time().rowsBetween(-lookback, -1)
    rows = df.withColumns({"x": F.collect_list(value).over(frame), "y": F.col(value)})
    return rows.filter(F.size("x") == lookback)


def _named(columns: dict[str, str]) -> list[Column]:
    return [F.expr(f"{text} as {name}") for name, text in columns.items()]
