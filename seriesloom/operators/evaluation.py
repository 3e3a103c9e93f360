"""Forecast accuracy, model selection and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def absolute_percentage_error(y: Column, yhat: Column) -> Column:
    """Row error in percent, missing where the actual is 0."""
    return F.try_divide(F.abs(y - yhat), F.abs(y)) * 100


def symmetric_percentage_error(y: Column, yhat: Column) -> Column:
    """Row error in percent of the mean magnitude, missing where both are 0."""
    return F.try_divide(F.abs(y - yhat), (F.abs(y) + F.abs(yhat)) / 2) * 100


def attach_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Pair validation predictions with actuals by (state, step).

    ``actuals`` holds (state, step, y); needed only for predictions made outside this library,
    whose models carry ``y`` along and so need no join.
    """
    return predictions.drop("y").join(actuals.select("state", "step", "y"), ["state", "step"])


METRICS = ["mae", "rmse", "mape", "smape"]


def error_metrics(use: Column, digits: int = 4) -> list[Column]:
    """MAE, RMSE, MAPE and sMAPE aggregates over the rows where ``use`` holds.

    MAPE is missing when every actual is 0.
    """
    y, yhat = F.when(use, F.col("y")), F.col("yhat")
    gap = y - yhat
    return [
        F.round(F.avg(F.abs(gap)), digits).alias("mae"),
        F.round(F.sqrt(F.avg(gap * gap)), digits).alias("rmse"),
        F.round(F.avg(absolute_percentage_error(y, yhat)), 4).alias("mape"),
        F.round(F.avg(symmetric_percentage_error(y, yhat)), 4).alias("smape"),
    ]


def score_models(predictions: DataFrame, digits: int = 4) -> DataFrame:
    """Metrics per state and model over validation rows with an actual."""
    known = F.col("y").isNotNull()
    scored = predictions.filter((F.col("phase") == "val") & known)
    return scored.groupBy("state", "model").agg(*error_metrics(known, digits))


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """The reader's view: money errors at cents."""
    return metrics.withColumns({"mae": F.round("mae", 2), "rmse": F.round("rmse", 2)})


def model_order(model: Column, names: list[str]) -> Column:
    """Place of a model in the competition, used to break ties; unlisted models come last."""
    place = F.array_position(F.array(*[F.lit(name) for name in names]), model)
    return F.when(place > 0, place).otherwise(len(names) + 1).cast("int")


def rank_models(metrics: DataFrame, names: list[str], primary: str = "mape") -> DataFrame:
    """Metrics with ``is_best``: lowest primary metric per state, then RMSE, then competition order.

    Ranking uses the rounded metrics; a missing metric comes last. A state has as many rows
    as there are models, so the window stays small.
    """
    ranked = rounded_metrics(metrics).withColumn("model_ord", model_order(F.col("model"), names))
    w = W.partitionBy("state").orderBy(
        F.asc_nulls_last(primary), F.asc_nulls_last("rmse"), F.asc("model_ord"), F.asc("model")
    )
    return ranked.withColumn("is_best", F.row_number().over(w) == 1)


def best_model(metrics: DataFrame, names: list[str], primary: str = "mape") -> DataFrame:
    """The winner per state; no rows for no metrics."""
    winners = rank_models(metrics, names, primary).filter("is_best")
    return winners.select("state", F.col("model").alias("best_model"), "mape", "rmse")


def model_wins(best: DataFrame) -> DataFrame:
    return best.groupBy("best_model").agg(F.count(F.lit(1)).alias("wins"))


def leaderboard(ranked: DataFrame) -> DataFrame:
    """Per winning model: wins, share of all states, mean MAPE of that model over all its states.

    Models with equal wins come in competition order. The number of states is an aggregate of its own.
    """
    models = ranked.groupBy("model").agg(
        F.count_if("is_best").alias("wins"), F.avg("mape").alias("avg_mape"), F.min("model_ord").alias("model_ord")
    )
    total = ranked.agg(F.count_if("is_best").alias("total")).scalar()
    board = models.withColumn("total_states", total).filter(F.col("wins") > 0).orderBy(F.desc("wins"), "model_ord", "model")
    return board.select(
        "model",
        "wins",
        F.round(F.col("wins") / F.col("total_states") * 100, 1).alias("win_pct"),
        F.round(F.coalesce("avg_mape", F.lit(0.0)), 2).alias("avg_val_mape"),
        "total_states",
    )
