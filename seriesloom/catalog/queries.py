"""One named query per operator; each takes (session, table folder) and returns a DataFrame.

All run over the whole tables. Results are rounded where engines differ in the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.calendar import fourier_pairs, holiday_calendar, holiday_days, is_holiday_month
from seriesloom.functions.parsing import parse_date, parse_money
from seriesloom.models import baselines, gbt_lag, per_series, seasonal_ar, seasonal_product, series_trees, trend_seasonal, window_huber
from seriesloom.models.frame import FUTURE, PHASES, VALIDATION, phase_frame
from seriesloom.models.registry import BASELINES, MODELS
from seriesloom.operators import analysis, cleaning, evaluation, features, panel as panels, sketches, stationarity
from seriesloom.plans import competition, records as rec, serving, stepwise, winners
from seriesloom.session import materialize, scratch_path
from seriesloom.sources import panel_store
from seriesloom.sources import sales as src
from seriesloom.sources import store as stores
from seriesloom.sources.delimited import scan_csv

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

STATE = "NATION_7"
EARLIER_REGION = "AMERICA"
EARLIER_REGIONS_SELECTED = "EUROPE"
LOOKBACK = 12
LATE = "2000-08-15"


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _sales(spark, d):
    return src.sales_observations(spark, d)


def _monthly(spark, d):
    return panels.monthly_sum(_sales(spark, d))


def _panel(spark, d):
    return panels.build_monthly_panel(_sales(spark, d))


def _split(spark, d):
    return panels.train_val_split(_panel(spark, d).drop("observed"))


def _frame_once(spark, d, phases=PHASES):
    """The phase frame in reliable storage, for models that read it several times."""
    return materialize(phase_frame(_panel(spark, d), phases))


def _predictions(spark, d):
    return baselines.baseline_predictions(phase_frame(_panel(spark, d)))


def _records(spark, d):
    return rec.forecast_records(_predictions(spark, d), BASELINES)


def _ranked(spark, d):
    return evaluation.rank_models(evaluation.score_models(_predictions(spark, d)), BASELINES)


def _customer_months(spark, d):
    return panels.monthly_sum(src.customer_observations(spark, d))


def _states_of_region(spark, d, name):
    """Request table: the nations of a region."""
    region = src.table(spark, d, "region").filter(F.col("r_name") == name)
    nation = src.table(spark, d, "nation")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("state"))


def _requests(spark, d):
    """Requested names: every nation in lower case and as stored, and region names, which are no states."""
    nation, region = src.table(spark, d, "nation"), src.table(spark, d, "region")
    lower = nation.select(F.lower("n_name").alias("request"))
    return lower.union(nation.select("n_name")).union(region.select("r_name"))


# Scans and cleaning


@query
def scan_raw(spark, d):
    """Write all untidy rows as CSV into the shared scratch folder, then scan the files back."""
    path = scratch_path(spark, "untidy")
    rows = src.untidy_observations(spark, d).withColumnRenamed("rid", "order_key")
    writer = rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return scan_csv(spark, path, ["order_key", "state", "date", "total"]).drop("rid")


@query
def normalize_columns(spark, d):
    raw = src.untidy_observations(spark, d).toDF(" Order Key", "STATE ", "Date", " Total ")
    return cleaning.normalize_columns(raw)


@query
def parse_dates(spark, d):
    raw = src.untidy_observations(spark, d)
    return raw.select("rid", F.col("date").alias("raw_date"), parse_date(F.col("date")).alias("date"))


@query
def clean_totals(spark, d):
    raw = src.untidy_observations(spark, d)
    return raw.select("rid", F.col("total").alias("raw_total"), parse_money(F.col("total")).alias("total"))


@query
def dedupe_first(spark, d):
    return cleaning.dedupe_first(cleaning.parse_observations(src.untidy_observations(spark, d)))


@query
def clean_sales(spark, d):
    return cleaning.clean_observations(src.untidy_observations(spark, d))


@query
def quality_report(spark, d):
    return cleaning.quality_report(src.untidy_observations(spark, d))


@query
def quality_observed(spark, d):
    """The counts of ``quality_report``, taken while the cleaned table is written: one scan for both."""
    path = scratch_path(spark, "clean")
    counts = cleaning.write_clean(src.untidy_observations(spark, d), path)
    return cleaning.counts_with_range(counts, spark.read.parquet(path))


@query
def distinct_sketches(spark, d):
    """Distinct customers per state and year, exact, out of the customers of each month."""
    months = sketches.monthly_values(src.customer_sales(spark, d), "customer")
    return sketches.counted(months, ["state", F.year("date").alias("year")])


@query
def select_states(spark, d):
    return serving.select_states(_monthly(spark, d), _states_of_region(spark, d, EARLIER_REGIONS_SELECTED))


@query
def resume_pending(spark, d):
    """States left to do when an earlier run finished those of one region."""
    targets = competition.targets_of(_monthly(spark, d))
    finished = serving.select_states(targets, _states_of_region(spark, d, EARLIER_REGION))
    return serving.pending_states(targets, finished)


# Panel


@query
def monthly_sum(spark, d):
    return _monthly(spark, d)


@query
def dense_grid(spark, d):
    return panels.dense_grid(_monthly(spark, d))


@query
def interpolate_linear(spark, d):
    return _round(panels.interpolate_linear(panels.dense_grid(_monthly(spark, d))), 6, "total")


@query
def forward_fill(spark, d):
    return panels.forward_fill(panels.dense_grid(_monthly(spark, d)))


@query
def back_fill(spark, d):
    return panels.back_fill(panels.dense_grid(_monthly(spark, d)))


@query
def min_periods(spark, d):
    """Customer series with data in at least twelve months."""
    return panels.enough_periods(_customer_months(spark, d))


@query
def dropped_states(spark, d):
    return panels.dropped_series(_customer_months(spark, d))


@query
def monthly_panel(spark, d):
    return _round(_panel(spark, d).select("state", "date", "total"), 6, "total")


@query
def train_val_split(spark, d):
    return _round(_split(spark, d), 6, "total")


@query
def full_series(spark, d):
    split = _split(spark, d)
    return _round(panels.part(split, "train").unionByName(panels.part(split, "val")), 6, "total")


@query
def split_report(spark, d):
    return panels.split_report(_split(spark, d))


@query
def split_overlap(spark, d):
    return panels.split_overlap(_split(spark, d))


@query
def min_train_filter(spark, d):
    """Customer series with at least ten training months beside the held-back ones."""
    return panels.trainable(panels.train_val_split(_customer_months(spark, d)), 10)


@query
def state_series(spark, d):
    return panels.series_of(_monthly(spark, d), STATE)


@query
def infer_frequency(spark, d):
    return panels.infer_frequency(_monthly(spark, d))


@query
def future_calendar(spark, d):
    return panels.future_calendar(_panel(spark, d), 2)


@query
def panel_summary(spark, d):
    return analysis.panel_summary(_panel(spark, d))


# Features


def _features(spark, d):
    return features.build_features(_panel(spark, d))


ROUNDED_FEATURES = ["sales", *features.feature_names()[:11], "sin_month", "cos_month", "yoy_growth"]


def _rounded_features(df):
    """Deviations at four places, all else at six: means of cents never fall on half of those."""
    names = [name for name in ROUNDED_FEATURES if name in df.columns]
    fine = _round(df, 6, *[name for name in names if "_std_" not in name])
    return _round(fine, 4, *[name for name in names if "_std_" in name])


@query
def build_features(spark, d):
    return _rounded_features(_features(spark, d))


@query
def model_features(spark, d):
    return _rounded_features(features.model_features(_panel(spark, d)))


@query
def supervised(spark, d):
    return _rounded_features(features.prepare_supervised(_features(spark, d)))


@query
def lag_features(spark, d):
    names = [f"lag_{k}" for k in features.LAGS]
    return _rounded_features(_features(spark, d).select("state", "date", *names))


@query
def rolling_mean(spark, d):
    names = [f"rolling_mean_{k}" for k in features.WINDOWS]
    return _rounded_features(_features(spark, d).select("state", "date", *names))


@query
def rolling_std(spark, d):
    names = [f"rolling_std_{k}" for k in features.WINDOWS]
    return _rounded_features(_features(spark, d).select("state", "date", *names))


@query
def calendar_features(spark, d):
    return _rounded_features(_features(spark, d).select("state", "date", *features.CALENDAR))


@query
def yoy_growth(spark, d):
    return _rounded_features(_features(spark, d).select("state", "date", "yoy_growth"))


@query
def next_step_features(spark, d):
    return _rounded_features(features.next_step_features(_panel(spark, d)))


@query
def holiday_calendar_of_orders(spark, d):
    years = src.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return holiday_calendar(years)


@query
def holiday_month(spark, d):
    return _monthly(spark, d).select("state", "date", is_holiday_month("date").alias("holiday_month"))


@query
def fourier_terms(spark, d):
    terms = {name: F.round(term, 6) for name, term in fourier_pairs("date", 4).items()}
    return _monthly(spark, d).select("state", "date").withColumns(terms)


@query
def scale_minmax(spark, d):
    scaled = features.min_max_scale(_split(spark, d))
    return _round(scaled.select("state", "date", "split", "z", "lo", "rng"), 6, "z", "lo", "rng")


@query
def inverse_scale(spark, d):
    scaled = features.min_max_scale(_split(spark, d))
    value = features.inverse_scale(F.col("z"), F.col("lo"), F.col("rng"))
    return scaled.select("state", "date", F.round(value, 4).alias("total"))


def _sequences(spark, d):
    return features.make_sequences(features.min_max_scale(_split(spark, d)), LOOKBACK)


@query
def make_sequences(spark, d):
    rows = _sequences(spark, d).select("state", "date", "y", F.posexplode("x").alias("pos", "x"))
    return _round(rows, 6, "x", "y")


@query
def tail_split(spark, d):
    return panels.tail_split(_sequences(spark, d)).select("state", "date", "part")


# Analysis


@query
def top_states(spark, d):
    return _round(analysis.top_states(_panel(spark, d)), 4, "total")


@query
def aggregate_trend(spark, d):
    return _round(analysis.aggregate_trend(_panel(spark, d)), 4, "total")


@query
def seasonality_pivot(spark, d):
    return _round(analysis.seasonality_pivot(_panel(spark, d)), 4, *[f"m{m:02d}" for m in analysis.MONTHS])


@query
def seasonal_decompose(spark, d):
    return _round(analysis.seasonal_decompose(_panel(spark, d)), 6, "total", "trend", "seasonal", "residual")


@query
def adf_test(spark, d):
    """Augmented test with the lags that AIC chooses."""
    return _round(stationarity.adf_test(panels.part(_split(spark, d), "train")), 6, "t_stat", "p_value")


@query
def adf_one_lag(spark, d):
    """Augmented test with one lagged difference."""
    made = stationarity.adf_test(panels.part(_split(spark, d), "train"), lags=1)
    return _round(made.select("state", "n", "t_stat", "stationary"), 4, "t_stat")


@query
def df_test(spark, d):
    return _round(analysis.df_test(panels.part(_split(spark, d), "train")), 6, "t_stat")


@query
def format_report(spark, d):
    top = analysis.top_states(_panel(spark, d))
    return top.select(
        "state",
        F.format_string("$%.2fB", F.col("total") / 1e9).alias("billions"),
        F.concat(F.lit("$"), F.format_number("total", 0)).alias("dollars"),
    )


# Forecasts that plain SQL can follow


def _one_model(made):
    return _round(made, 4, "yhat", "y")


@query
def forecast_seasonal_naive(spark, d):
    return _one_model(baselines.seasonal_naive(phase_frame(_panel(spark, d))))


@query
def forecast_linear_trend(spark, d):
    return _one_model(baselines.linear_trend(phase_frame(_panel(spark, d))))


@query
def score_models(spark, d):
    return evaluation.score_models(_predictions(spark, d))


@query
def best_model(spark, d):
    return evaluation.best_model(evaluation.score_models(_predictions(spark, d)), BASELINES)


@query
def model_wins(spark, d):
    return evaluation.model_wins(_records(spark, d))


@query
def leaderboard(spark, d):
    return evaluation.leaderboard(_ranked(spark, d))


@query
def order_candidates(spark, d):
    return seasonal_ar.order_candidates(analysis.df_test(panels.part(_split(spark, d), "train")))


@query
def best_forecast(spark, d):
    return rec.forecast_points(_records(spark, d), 4)


@query
def forecast_points(spark, d):
    nested = _records(spark, d).select("state", "best_model", F.col("forecast.date").alias("dates"), F.col("forecast.value").alias("values"))
    return _round(rec.zip_points(nested, "dates", "values"), 4, "value")


@query
def compare_models(spark, d):
    return rec.compare_models(_records(spark, d), 4)


@query
def forecast_record(spark, d):
    """The nested record, one scalar per row."""
    made = _records(spark, d).select("state", "fit_end", "best_model", "forecast", "validation", "metrics")
    ahead = made.select("state", "fit_end", "best_model", F.lit("forecast").alias("part"), F.inline("forecast"))
    held = made.select("state", "fit_end", "best_model", F.lit("validation").alias("part"), F.inline("validation"))
    return _round(ahead.unionByName(held), 4, "value")


@query
def final_summary(spark, d):
    return rec.final_summary(_records(spark, d), 4)


@query
def chart_frame(spark, d):
    return _round(rec.chart_frame(_split(spark, d), _records(spark, d)), 4, "value")


@query
def list_states(spark, d):
    return serving.list_states(_records(spark, d))


@query
def lookup_state(spark, d):
    found = serving.lookup_states(_requests(spark, d), _records(spark, d))
    return found.select("request", "state", "best_model")


@query
def batch_lookup(spark, d):
    return serving.batch_lookup(_requests(spark, d), _records(spark, d), 4)


@query
def history_view(spark, d):
    """The panel serves the history and the forecasts, so it is computed once."""
    panel = materialize(_panel(spark, d))
    made = rec.forecast_records(baselines.baseline_predictions(phase_frame(panel)), BASELINES)
    return serving.history_view(panel, made, digits=4)


@query
def forecast_response(spark, d):
    """The answer to each request, one row per forecast point."""
    found = serving.forecast_response(_requests(spark, d), _records(spark, d), 4)
    rows = found.select("state", "best_model", "forecast_steps", "unit", F.posexplode("forecast").alias("at", "p"))
    return rows.select(
        "state", "best_model", "forecast_steps", "unit", (F.col("at") + 1).alias("step"), F.col("p.date").alias("date"),
        F.col("p.value").alias("value"),
    )


@query
def health(spark, d):
    return serving.health(serving.loaded(_records(spark, d)))


@query
def store_round_trip(spark, d):
    """Records written to Parquet, exported as JSON and read back, one row per forecast point."""
    path = scratch_path(spark, "store")
    stores.write_records(_records(spark, d), f"{path}/parquet")
    stores.export_json(stores.read_records(spark, f"{path}/parquet"), f"{path}/json")
    return rec.forecast_points(stores.import_json(spark, f"{path}/json"), 4)


@query
def stored_panel(spark, d):
    """The panel read from the bucketed store after the observations of the last year were merged into it."""
    table = f"panel_{uuid.uuid4().hex}"
    sales = _sales(spark, d)
    late = F.col("date") >= F.lit(LATE)
    panel_store.create_store(sales.filter(~late), table, path=scratch_path(spark, "panel"))
    panel_store.merge_observations(sales.filter(late), table)
    return _round(panel_store.stored_panel(spark, table).select("state", "date", "total"), 6, "total")


class Interrupted(Exception):
    """Ends the first of two jobs on one store."""


@query
def stepwise_commit(spark, d):
    """Forecasts read from a store whose job was broken off after two of four groups and then went on."""
    path, panel = scratch_path(spark, "steps"), materialize(_panel(spark, d))
    finished = []

    def stop_at_two(group):
        finished.append(group)
        if len(finished) == 2:
            raise Interrupted

    try:
        stepwise.compete_in_steps(panel, path, 4, stop_at_two, names=BASELINES)
    except Interrupted:
        stepwise.compete_in_steps(panel, path, 4, names=BASELINES)
    return rec.forecast_points(stepwise.read_steps(spark, path), 4)


class RecentMean:
    """A model of a user: the mean of the last months."""

    def __init__(self, months: int = 12):
        self.months = months

    def fit(self, series):
        self.level = series.iloc[-self.months :].mean()
        return self

    def predict(self, steps):
        return [self.level] * steps

    def get_params(self):
        return {"months": self.months, "fitted_level": round(self.level, 2)}


class RisingOnly(RecentMean):
    """A model that refuses series whose last month is below the first one."""

    def fit(self, series):
        if series.iloc[-1] < series.iloc[0]:
            raise ValueError(f"fell over {len(series)} months")
        return super().fit(series)


@query
def forecast_plugin(spark, d):
    """Forecasts of a plain Python class that is fitted on every series."""
    made = per_series.forecast_each("recent_mean", RecentMean, phase_frame(_panel(spark, d)), months=12)
    return _round(made.filter("error is null").select("state", "model", "phase", "step", "date", "yhat"), 4, "yhat")


@query
def plugin_failures(spark, d):
    """The texts of the series that a Python class refuses, each with its own reason."""
    made = per_series.forecast_each("rising_only", RisingOnly, phase_frame(_panel(spark, d)))
    return made.filter("error is not null").select("state", "model", "phase", F.col("error").alias("reason"))


def _customer_frame(spark, d):
    return phase_frame(_customer_months(spark, d))


@query
def skipped_series(spark, d):
    """Customer series that are too short for a baseline, with the reason."""
    frame = _customer_frame(spark, d)
    return baselines.skipped_naive(frame).unionByName(baselines.skipped_trend(frame))


@query
def failed_states(spark, d):
    """Customers for which no baseline could be scored."""
    made = rec.forecast_records(baselines.baseline_predictions(_customer_frame(spark, d)), BASELINES)
    return rec.failed_states(_customer_months(spark, d), made)


@query
def monotone_dates(spark, d):
    """Whether the dates of each series rise from row to row."""
    previous = F.lag("date").over(panels.in_time())
    rows = _panel(spark, d).select("state", F.coalesce(F.col("date") > previous, F.lit(True)).alias("rises"))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.bool_and("rises").alias("monotone"))


# What models are fitted on: exact, beside forecasts that are not


@query
def gbt_training_rows(spark, d):
    """Scaled features and label of the pooled trees, one row per feature."""
    rows = gbt_lag.training_rows(phase_frame(_panel(spark, d), (FUTURE,)), FUTURE.name)
    long = rows.select("state", "date", "label", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return _round(long, 4, "label", "value")


@query
def huber_windows(spark, d):
    """Scaled lookback windows and labels of the pooled regression, one row per window cell."""
    rows = window_huber.training_rows(phase_frame(_panel(spark, d), (FUTURE,)), FUTURE.name)
    long = rows.select("state", "date", "label", F.posexplode(vector_to_array("features")).alias("pos", "x"))
    return _round(long, 6, "label", "x")


@query
def trend_design(spark, d):
    """Design columns of the trend with seasonality, one row per column."""
    shape = trend_seasonal.Shape()
    rows = trend_seasonal.history(phase_frame(_panel(spark, d), (FUTURE,)), shape)
    cells = F.array(*[F.col(f"x{i}").cast("double") for i in range(shape.holiday.stop)])
    return _round(rows.select("state", "date", F.posexplode(cells).alias("pos", "x")), 6, "x")


@query
def model_output_checks(spark, d):
    """Of every forecast of every model: its place in time, whether it is a number of 0 or more, the actual beside it."""
    made = competition.compete(_panel(spark, d), list(MODELS)).predictions
    good = F.coalesce((F.col("yhat") >= 0) & ~F.isnan("yhat"), F.lit(False)).alias("good")
    return made.select("state", "model", "phase", "step", "date", good, F.round("y", 4).alias("y"))


# Model forecasts: no exact SQL


@query
def order_scores(spark, d):
    """All 72 orders per series with their AIC or the reason for none."""
    return _round(seasonal_ar.order_scores(phase_frame(_panel(spark, d), (FUTURE,))), 4, "aic")


@query
def series_parameters(spark, d):
    rows = seasonal_ar.series_parameters(phase_frame(_panel(spark, d)))
    return rows.select("state", "phase", "model", F.explode("params").alias("name", "value"))


@query
def fitted_values(spark, d):
    return _round(seasonal_ar.fitted_values(phase_frame(_panel(spark, d))), 4, "total", "fitted")


@query
def forecast_seasonal_ar(spark, d):
    return _one_model(seasonal_ar.forecast(phase_frame(_panel(spark, d))))


@query
def forecast_seasonal_product(spark, d):
    """Forecasts of the order chosen among products of lag polynomials."""
    return _one_model(seasonal_product.forecast(phase_frame(_panel(spark, d))))


@query
def product_order_scores(spark, d):
    """All 72 products of lag polynomials per series: sums of squares before and after the steps, AIC or reason."""
    made = seasonal_product.order_scores(phase_frame(_panel(spark, d), (FUTURE,)))
    return _round(made, 4, "start_sse", "sse", "aic")


@query
def order_search(spark, d):
    return _round(seasonal_ar.order_search(phase_frame(_panel(spark, d))), 4, "aic")


@query
def forecast_trend_seasonal(spark, d):
    return _one_model(trend_seasonal.forecast(phase_frame(_panel(spark, d))))


@query
def forecast_trend_sparse(spark, d):
    """Forecasts with sparse change points and one column per holiday."""
    return _one_model(trend_seasonal.forecast(phase_frame(_panel(spark, d)), sparse=True, named_holidays=True))


@query
def trend_changes(spark, d):
    """Months in which the trend of a state changes."""
    return _round(trend_seasonal.trend_changes(phase_frame(_panel(spark, d))), 8, "slope_change")


@query
def holiday_effects(spark, d):
    return _round(trend_seasonal.holiday_effects(phase_frame(_panel(spark, d), (FUTURE,)), sparse=True), 8, "effect")


@query
def holiday_day_counts(spark, d):
    """Days of each holiday per month of the panel."""
    months = _panel(spark, d).select("date").distinct()
    named = [F.struct(F.lit(name).alias("holiday"), days.alias("days")) for name, days in holiday_days("date").items()]
    return months.select("date", F.inline(F.array(*named))).filter("days > 0")


@query
def forecast_components(spark, d):
    return trend_seasonal.components(phase_frame(_panel(spark, d), (FUTURE,)))


@query
def fit_gbt(spark, d):
    """Training rows with the fitted label of the pooled trees."""
    frame = _frame_once(spark, d, (FUTURE,))
    model = gbt_lag.fit(frame, FUTURE.name)
    return model.transform(gbt_lag.training_rows(frame, FUTURE.name)).select("state", "date", "label", "prediction")


@query
def forecast_gbt(spark, d):
    return _one_model(gbt_lag.forecast(_frame_once(spark, d), PHASES))


@query
def forecast_gbt_pooled(spark, d):
    """Forecasts of the pooled trees, one model per phase for all series."""
    return _one_model(gbt_lag.forecast(_frame_once(spark, d), PHASES, pooled=True))


@query
def series_importance(spark, d):
    """Share of each feature in the gain of the trees of each series."""
    made = series_trees.fit(_frame_once(spark, d, (VALIDATION,)), (VALIDATION,))
    return _round(series_trees.importance(made), 6, "importance")


@query
def feature_importance(spark, d):
    frame = _frame_once(spark, d, (VALIDATION,))
    return gbt_lag.feature_importance(gbt_lag.fit(frame, VALIDATION.name), frame)


@query
def forecast_window_huber(spark, d):
    return _one_model(window_huber.forecast(_frame_once(spark, d), PHASES))


@query
def penalty_path(spark, d):
    """Error on the inner hold-out for every penalty of the pooled regression."""
    return _round(window_huber.penalty_path(_frame_once(spark, d, (VALIDATION,)), (VALIDATION,)), 6, "error")


@query
def stored_winners(spark, d):
    """Forecasts out of a table of the winning fits, without fitting: the same as ``best_forecast``."""
    panel, path = materialize(_panel(spark, d)), scratch_path(spark, "winners")
    records = rec.forecast_records(baselines.baseline_predictions(phase_frame(panel)), BASELINES)
    winners.store_winners(panel, records, path)
    return _round(winners.forecast_from_store(spark, path), 4, "value")


@query
def winner_parameters(spark, d):
    """Parameters of the winner of every state among all models."""
    panel, path = materialize(_panel(spark, d)), scratch_path(spark, "winners")
    winners.store_winners(panel, competition.compete(panel, list(MODELS)).records, path)
    return winners.read_winners(spark, path).select("state", "model", F.explode("params").alias("name", "setting"))


@query
def full_competition(spark, d):
    """All models on all series: the winner and its first forecasts per state."""
    outcome = competition.compete(_panel(spark, d), list(MODELS))
    return rec.final_summary(outcome.records)


REGISTRY["holiday_calendar"] = REGISTRY.pop("holiday_calendar_of_orders")
