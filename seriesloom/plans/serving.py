"""Lookups over the forecast records and the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.panel import last_rows

# Texts and limits of the answers.
UNIT = "USD (monthly sales)"
NOT_FOUND = "'%s' not found. GET /states for list."
HISTORY_DEFAULT, HISTORY_LEAST, HISTORY_MOST = 36, 3, 120


class EmptyStore(LookupError):
    """No forecasts are stored."""


def loaded(records: DataFrame) -> DataFrame:
    """``records``, or an error when there are none."""
    if records.isEmpty():
        raise EmptyStore("no forecasts are stored; run the competition first")
    return records


def list_states(records: DataFrame) -> DataFrame:
    """Stored states by name. Pass ``loaded(records)`` for an error on an empty store."""
    return records.select("state").distinct().orderBy("state")


def health(records: DataFrame) -> DataFrame:
    return records.agg(F.lit("healthy").alias("status"), F.countDistinct("state").alias("states_loaded"))


def lookup_states(requests: DataFrame, records: DataFrame) -> DataFrame:
    """The record behind each distinct requested name; an exact name wins over another spelling.

    Names are matched first, on narrow rows of an inner join in which the few requests can be the broadcast
    side; the records of the chosen states are fetched last, again with the small side free to be broadcast.
    """
    asked = requests.select("request").distinct()
    names = records.select("state").withColumn("_key", F.lower("state"))
    hits = names.join(asked.withColumn("_key", F.lower("request")), "_key")
    choice = F.min(F.struct(F.col("request") != F.col("state"), F.col("state").alias("name")))["name"]
    chosen = hits.groupBy("request").agg(choice.alias("state"))
    found = records.join(chosen, "state")
    return asked.join(found, "request", "left").select("request", *records.columns)


def forecast_response(requests: DataFrame, records: DataFrame, digits: int = 2) -> DataFrame:
    """Forecast per found request under its requested spelling."""
    found = lookup_states(requests, records).filter(F.col("state").isNotNull())
    return found.select(
        F.col("request").alias("state"),
        "best_model",
        F.size("forecast").alias("forecast_steps"),
        F.lit(UNIT).alias("unit"),
        F.transform("forecast", lambda p: F.struct(p["date"].alias("date"), F.round(p["value"], digits).alias("value"))).alias("forecast"),
    )


def batch_lookup(requests: DataFrame, records: DataFrame, digits: int = 2) -> DataFrame:
    """One row per forecast point of a found request, one row with the error of a missing one."""
    answers = lookup_states(requests, records)
    error = F.when(F.col("state").isNull(), F.format_string(NOT_FOUND, F.col("request")))
    rows = answers.select("request", "best_model", error.alias("error"), F.posexplode_outer("forecast").alias("at", "p"))
    return rows.select(
        "request",
        "best_model",
        (F.col("at") + 1).alias("step"),
        F.col("p.date").alias("date"),
        F.round("p.value", digits).alias("value"),
        "error",
    )


def check_history_length(n: int) -> int:
    if not HISTORY_LEAST <= n <= HISTORY_MOST:
        raise ValueError(f"history length must be {HISTORY_LEAST} to {HISTORY_MOST} months, got {n}")
    return n


def history_view(panel: DataFrame, records: DataFrame, n: int = HISTORY_DEFAULT, digits: int = 2) -> DataFrame:
    """The last n panel rows of each stored state, followed by its forecast."""
    recent = last_rows(panel, check_history_length(n))
    past = recent.join(records.select("state"), "state", "left_semi").select(
        "state", F.lit("history").alias("kind"), "date", F.round("total", digits).alias("value")
    )
    ahead = records.select("state", F.lit("forecast").alias("kind"), F.inline("forecast"))
    return past.unionByName(ahead.withColumn("value", F.round("value", digits)))


def history_of(panel: DataFrame, records: DataFrame, state: str, n: int = HISTORY_DEFAULT) -> DataFrame:
    """``history_view`` of one state, whatever the case of its name."""
    same: Column = F.lower("state") == state.lower()
    return history_view(panel.filter(same), records.filter(same), n)


def pending_states(targets: DataFrame, store: DataFrame) -> DataFrame:
    """Targets without a stored record for the same last month; new data makes a record stale."""
    return targets.join(store.select("state", "fit_end"), ["state", "fit_end"], "left_anti")


def select_states(panel: DataFrame, request: DataFrame | list[str] | None = None) -> DataFrame:
    """Rows of the requested states; every state without a request."""
    if request is None:
        return panel
    if isinstance(request, list):
        return panel.filter(F.col("state").isin(request))
    return panel.join(request.select("state"), "state", "left_semi")
