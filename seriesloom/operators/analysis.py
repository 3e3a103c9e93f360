"""Descriptive queries: rankings, trends, seasonality, decomposition, stationarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.functions.sums import exact_sum
from seriesloom.operators.panel import IN_TIME, by_series, in_time

MONTHS = list(range(1, 13))
PERIOD = 12


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("state").alias("n_states"),
        F.countDistinct("date").alias("n_months"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def top_states(panel: DataFrame, k: int = 10) -> DataFrame:
    sums = panel.groupBy("state").agg(exact_sum("total").alias("total"))
    return sums.orderBy(F.desc("total"), "state").limit(k)


def aggregate_trend(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(exact_sum("total").alias("total"))


def seasonality_pivot(panel: DataFrame) -> DataFrame:
    """Year by month sums, 0 where a month has no rows; the twelve columns are fixed.

    Rows are added per year and month first, so the twelve cells look at few rows.
    """
    months = panel.groupBy(F.year("date").alias("year"), F.month("date").alias("month"))
    sums = months.agg(exact_sum("total").alias("total"))
    cells = [
        F.coalesce(F.max(F.when(F.col("month") == m, F.col("total"))), F.lit(0.0)).alias(f"m{m:02d}") for m in MONTHS
    ]
    return sums.groupBy("year").agg(*cells)


def seasonal_decompose(panel: DataFrame) -> DataFrame:
    """Multiplicative trend, seasonal and residual parts of every row of the panel.

    Trend is the centred moving average over one period with half weights at both ends; it is
    missing for half a period at either end. Series under two full years or holding a value of 0
    or less have no multiplicative decomposition: their parts are NULL and ``reason`` says why.
    """
    half = PERIOD // 2
    inner = in_time().rowsBetween(1 - half, half - 1)
    outer = in_time().rowsBetween(-half, half)
    ends = F.lag("total", half).over(in_time()) + F.lead("total", half).over(in_time())
    average = (F.sum("total").over(inner) + F.lit(0.5) * ends) / PERIOD
    rows = panel.select(
        "state",
        "date",
        "total",
        (F.row_number().over(in_time()) - 1).alias("at"),
        F.count(F.lit(1)).over(by_series()).alias("n"),
        F.min("total").over(by_series()).alias("least"),
        F.when(F.count("total").over(outer) == PERIOD + 1, average).alias("trend"),
    )
    reason = F.when(F.col("n") < 2 * PERIOD, f"fewer than {2 * PERIOD} months").when(
        F.coalesce(F.col("least") <= 0, F.lit(True)), "a value of 0 or less"
    )
    rows = rows.withColumn("reason", reason).withColumn("trend", F.when(F.col("reason").isNull(), F.col("trend")))
    phase = F.col("at") % PERIOD
    same_phase = W.partitionBy("state", phase)
    rows = rows.withColumn("phase_mean", F.avg(F.try_divide("total", "trend")).over(same_phase))
    level = F.avg(F.when(F.col("at") < PERIOD, F.col("phase_mean"))).over(by_series())
    rows = rows.withColumn("seasonal", F.col("phase_mean") / level)
    residual = F.col("total") / F.col("seasonal") / F.col("trend")
    return rows.select("state", "date", "total", "trend", "seasonal", residual.alias("residual"), "reason")


# 5% critical value with a constant for n rows, finite-sample response surface (MacKinnon 1991).
CRITICAL = "(-2.8621D - 2.738D / {0} - 8.36D / ({0} * {0}))"


def dickey_fuller_statistic(delta: str, level: str, window: str | None = None) -> tuple[str, str]:
    """SQL text of (t statistic, row count) of regressing the change on the previous level."""
    over = f" over ({window})" if window else ""
    n, sxx, syy, sxy = (
        f"regr_{name}({delta}, {level}){over}" for name in ("count", "sxx", "syy", "sxy")
    )
    slope = f"try_divide({sxy}, {sxx})"
    variance = f"try_divide({syy} - {slope} * {sxy}, {n} - 2)"
    return f"try_divide({slope}, sqrt(try_divide({variance}, {sxx})))", n


def df_test(panel: DataFrame) -> DataFrame:
    """Dickey-Fuller test (lag 0, constant) per series; a test that fails means not stationary."""
    changes = panel.selectExpr("state", f"lag(total) over ({IN_TIME}) as level", "total")
    statistic, n = dickey_fuller_statistic("total - level", "level")
    tested = changes.groupBy("state").agg(F.expr(f"{n} as n"), F.expr(f"{statistic} as t_stat"))
    return tested.withColumn("stationary", F.expr(f"coalesce(t_stat < {CRITICAL.format('n')}, false)"))


def exploratory_report(panel: DataFrame) -> dict[str, DataFrame]:
    """The tables looked at before any training."""
    return {
        "summary": panel_summary(panel),
        "top_states": top_states(panel),
        "aggregate_trend": aggregate_trend(panel),
        "seasonality": seasonality_pivot(panel),
        "decomposition": seasonal_decompose(panel),
    }
