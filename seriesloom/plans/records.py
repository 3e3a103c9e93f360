"""One row per state with everything a forecast lookup needs.

Predictions are already partitioned by series, so metrics, choice of the winner and nesting
all happen in that partitioning; a state holds models x steps values, a small fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.evaluation import METRICS, error_metrics, model_order


def _points(when: Column, value: str) -> Column:
    """Array of (date, value) in time order over the rows where ``when`` holds."""
    return F.array_sort(F.collect_list(F.when(when, F.struct("date", F.col(value).alias("value")))))


def forecast_records(predictions: DataFrame, names: list[str], primary: str = "mape") -> DataFrame:
    """``(state, fit_end, best_model, metrics, forecast, all_forecasts, validation, val_forecasts)``.

    States where no model could be scored are absent: they failed.
    """
    val, future = F.col("phase") == "val", F.col("phase") == "future"
    scored = val & F.col("y").isNotNull()
    models = predictions.groupBy("state", "model").agg(
        F.max(F.when(val, F.col("date"))).alias("fit_end"),
        F.count_if(scored).alias("n"),
        *error_metrics(scored),
        _points(future, "yhat").alias("future"),
        _points(scored, "yhat").alias("val"),
        _points(scored, "y").alias("actual"),
    )
    scored_ord = F.when(F.col("n") > 0, model_order(F.col("model"), names))
    entry = F.struct(
        scored_ord.isNull().alias("unscored"),
        F.col(primary).isNull().alias("last"),
        F.round(primary, 2 if primary in ("mae", "rmse") else 4).alias("error"),
        F.round("rmse", 2).alias("error_2"),
        scored_ord.alias("ord"),
        "model",
        *METRICS,
        "future",
        "val",
        "actual",
        "fit_end",
    )
    states = models.groupBy("state").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    first = F.get("ranked", F.lit(0))
    states = states.withColumn("first", first).filter(~F.col("first.unscored"))
    in_order = F.array_sort(
        F.transform("ranked", lambda e: F.struct(e["ord"].alias("ord"), e["model"].alias("model"), e.alias("e")))
    )
    states = states.withColumn("models", F.transform(in_order, lambda x: x["e"]))
    competed = F.filter("models", lambda e: ~e["unscored"])
    return states.select(
        "state",
        F.col("first.fit_end").alias("fit_end"),
        F.col("first.model").alias("best_model"),
        F.transform(
            competed, lambda e: F.struct(e["model"].alias("model"), *[e[m].alias(m) for m in METRICS])
        ).alias("metrics"),
        F.col("first.future").alias("forecast"),
        F.map_from_entries(F.transform("models", lambda e: F.struct(e["model"], e["future"]))).alias("all_forecasts"),
        F.col("first.actual").alias("validation"),
        F.map_from_entries(F.transform(competed, lambda e: F.struct(e["model"], e["val"]))).alias("val_forecasts"),
    )


def record_metrics(records: DataFrame) -> DataFrame:
    """Metrics of the records as rows in competition order, with the winner marked."""
    rows = records.select("state", "best_model", F.posexplode("metrics").alias("at", "m"))
    best = (F.col("m.model") == F.col("best_model")).alias("is_best")
    return rows.select("state", "m.*", best, (F.col("at") + 1).alias("model_ord"))


def forecast_points(records: DataFrame, digits: int = 2) -> DataFrame:
    """The winner's forecast as rows."""
    rows = records.select("state", "best_model", F.posexplode("forecast").alias("at", "p"))
    return rows.select(
        "state",
        "best_model",
        (F.col("at") + 1).alias("step"),
        F.col("p.date").alias("date"),
        F.round("p.value", digits).alias("value"),
    )


def zip_points(nested: DataFrame, dates: str, values: str) -> DataFrame:
    """Rows out of two arrays paired by position; surplus entries of the longer one are left out."""
    pairs = F.arrays_zip(
        F.slice(dates, 1, F.least(F.size(dates), F.size(values))).alias("date"),
        F.slice(values, 1, F.least(F.size(dates), F.size(values))).alias("value"),
    )
    rest = [name for name in nested.columns if name not in (dates, values)]
    rows = nested.select(*rest, F.posexplode(pairs).alias("at", "p"))
    return rows.select(*rest, (F.col("at") + 1).alias("step"), F.col("p.date").alias("date"), F.col("p.value").alias("value"))


def compare_models(records: DataFrame, digits: int = 2) -> DataFrame:
    """Every model's forecast beside its metrics; metrics are missing for a model that was not scored."""
    rows = records.select("state", "best_model", "metrics", F.explode("all_forecasts").alias("model", "points"))
    metric = F.get(F.filter("metrics", lambda m: m["model"] == F.col("model")), F.lit(0))
    rows = rows.withColumn("m", metric).select("state", "best_model", "model", "m", F.posexplode("points").alias("at", "p"))
    return rows.select(
        "state",
        "best_model",
        "model",
        *[F.col("m")[name].alias(name) for name in METRICS],
        (F.col("at") + 1).alias("step"),
        F.col("p.date").alias("date"),
        F.round("p.value", digits).alias("value"),
    )


def final_summary(records: DataFrame, digits: int = 2) -> DataFrame:
    """Winner and first two forecasts per state."""
    value = lambda i: F.round(F.get("forecast", F.lit(i))["value"], digits)
    return records.select("state", "best_model", value(0).alias("step_1"), value(1).alias("step_2"))


def failed_states(targets: DataFrame, records: DataFrame) -> DataFrame:
    """Targets without a record."""
    return targets.select("state").distinct().join(records.select("state"), "state", "left_anti")


def chart_frame(split: DataFrame, records: DataFrame) -> DataFrame:
    """Long rows behind the chart of a state: train, val, each model's val forecast, the forecast."""
    observed = split.select("state", F.col("split").alias("kind"), F.lit(None).cast("string").alias("model"), "date", F.col("total").alias("value"))
    tried = records.select("state", F.explode("val_forecasts").alias("model", "points"))
    tried = tried.select("state", F.lit("val_forecast").alias("kind"), "model", F.inline("points"))
    winner = records.select("state", F.lit("forecast").alias("kind"), F.col("best_model").alias("model"), F.inline("forecast"))
    return observed.unionByName(tried).unionByName(winner)
