"""The whole job: fit every model on every series, score, choose, forecast, store.

All series go through each model together; nothing loops over states. Intermediate tables
that several models read are computed once into reliable storage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models import gbt_lag, seasonal_ar, seasonal_product, trend_seasonal, window_huber
from seriesloom.models.frame import FUTURE, PHASES, Phase, phase_frame
from seriesloom.models.registry import MODELS, SKIPPED, Settings
from seriesloom.operators.panel import train_val_split, trainable
from seriesloom.plans.records import failed_states, forecast_records
from seriesloom.plans.serving import pending_states, select_states
from seriesloom.session import materialize, side_by_side, union
from seriesloom.sources.store import write_coefficients, write_records

FAILURE = "state string, phase string, model string, reason string"


@dataclass
class Outcome:
    predictions: DataFrame
    records: DataFrame
    failures: DataFrame
    failed: DataFrame


def targets_of(panel: DataFrame) -> DataFrame:
    return panel.groupBy("state").agg(F.max("date").alias("fit_end"))


def _refused(rows: DataFrame, kept: DataFrame, held: int, min_train: int) -> DataFrame:
    """States with too few training rows, with the reason."""
    sizes = rows.groupBy("state").agg(F.greatest(F.count(F.lit(1)) - held, F.lit(0)).alias("n"))
    short = sizes.join(kept.select("state").distinct(), "state", "left_anti")
    reason = F.format_string(f"%d training months, the competition needs at least {min_train}", "n")
    return short.select("state", F.lit(None).cast("string").alias("phase"), F.lit(None).cast("string").alias("model"), reason.alias("reason"))


def _unknown(panel: DataFrame, request: DataFrame | list[str] | None) -> DataFrame | None:
    """Requested names that are not in the panel, with the reason."""
    if request is None:
        return None
    if isinstance(request, list):
        request = panel.sparkSession.createDataFrame([(name,) for name in request], "state string")
    names = request.select("state").distinct().join(panel.select("state").distinct(), "state", "left_anti")
    return names.select("state", F.lit(None).cast("string").alias("phase"), F.lit(None).cast("string").alias("model"), F.lit("not in the panel").alias("reason"))


def _own_errors(made: DataFrame, name: str) -> DataFrame:
    """Series whose fit failed, with the text that the model gave for it."""
    told = made.filter("error is not null")
    return told.select("state", "phase", F.lit(name).alias("model"), F.col("error").alias("reason"))


def _without_forecast(frame: DataFrame, made: DataFrame, name: str, skipped: DataFrame | None) -> DataFrame:
    """Series that a model took on but gave neither a forecast nor a reason for."""
    keys = ["state", "phase"]
    rest = frame.select(*keys).distinct().join(made.select(*keys).distinct(), keys, "left_anti")
    if skipped is not None:
        rest = rest.join(skipped.select(*keys), keys, "left_anti")
    return rest.select(*keys, F.lit(name).alias("model"), F.lit("its estimate failed").alias("reason"))


def compete(
    panel: DataFrame,
    names: list[str] | None = None,
    phases: tuple[Phase, ...] = PHASES,
    min_train: int = 15,
    primary: str = "mape",
    request: DataFrame | list[str] | None = None,
    store: DataFrame | None = None,
    store_path: str | None = None,
    settings: Settings | None = None,
) -> Outcome:
    """Run the competition on the requested states that the store does not hold yet.

    ``settings`` maps model names to keyword arguments. Every model's predictions are computed on
    their own, so one that fails while it runs leaves the others intact. ``failures`` has the whole
    text of such an error, and a row for every series that a model did not forecast, with the reason that the
    model itself gives for this series where it has one, and for every state with too few rows and every requested name that is not in the panel.
    """
    spark = panel.sparkSession
    names = names or list(MODELS)
    settings = settings or {}
    rows = materialize(select_states(panel, request).select("state", "date", "total"))
    if store is not None:
        rows = rows.join(pending_states(targets_of(rows), store).select("state"), "state", "left_semi")
    held = max(phase.held_back for phase in phases)
    kept = trainable(train_val_split(rows, held), min_train).drop("split")
    frame = materialize(phase_frame(kept, phases))

    def attempt(name: str) -> DataFrame | str:
        try:
            return materialize(MODELS[name](frame, phases, **settings.get(name, {})))
        except Exception as error:  # one model must not stop the others
            return str(error)

    tried = dict(zip(names, side_by_side([lambda name=name: attempt(name) for name in names])))
    made = {name: result for name, result in tried.items() if not isinstance(result, str)}
    broken = [(None, None, name, result) for name, result in tried.items() if isinstance(result, str)]
    reasons = [_refused(rows, frame, held, min_train)]
    if (unknown := _unknown(panel, request)) is not None:
        reasons.append(unknown)
    for name in names:
        skipped = SKIPPED[name](frame) if name in SKIPPED else None
        if skipped is not None:
            reasons.append(skipped)
        if name in made:
            reasons.append(_without_forecast(frame, made[name], name, skipped))
            if "error" in made[name].columns:
                reasons.append(_own_errors(made[name], name))
                made[name] = made[name].filter("error is null").drop("error")
    if broken:
        reasons.append(spark.createDataFrame(broken, FAILURE))
    if not made:
        raise RuntimeError("no model could be run: " + "; ".join(f"{name}: {text}" for _, _, name, text in broken))
    predictions = union(list(made.values()))
    records = forecast_records(predictions, names, primary)
    if store_path:
        write_records(records, store_path)
    asked = rows if unknown is None else rows.select("state").union(unknown.select("state"))
    return Outcome(predictions, records, union(reasons), failed_states(asked, records))


def save_fits(panel: DataFrame, path: str, settings: Settings | None = None) -> None:
    """Fit on all data and keep the fitted models: tables for per-series fits, model folders for pooled ones."""
    of = lambda model: (settings or {}).get(model.NAME, {})
    frame = materialize(phase_frame(panel, (FUTURE,)))
    seasonal = {k: v for k, v in of(seasonal_ar).items() if k != "product"}
    made = (seasonal_product if of(seasonal_ar).get("product") else seasonal_ar).fit(frame, **seasonal)
    write_coefficients(made, f"{path}/{seasonal_ar.NAME}")
    write_coefficients(trend_seasonal.fit(frame, **of(trend_seasonal)), f"{path}/{trend_seasonal.NAME}")
    gbt_lag.save(gbt_lag.fit(frame, FUTURE.name, **of(gbt_lag)), f"{path}/{gbt_lag.NAME}")
    for _, model in window_huber.fit_groups(frame, (FUTURE,), **of(window_huber)):
        model.write().overwrite().save(f"{path}/{window_huber.NAME}/{model.numFeatures}")
