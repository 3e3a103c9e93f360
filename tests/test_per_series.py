"""Python classes as models, and the reasons of single series."""

import numpy as np
import pandas as pd
import pytest
from months import month_ends

from seriesloom.models import per_series, seasonal_ar
from seriesloom.models.frame import FUTURE, phase_frame
from seriesloom.models.registry import MODELS, PARAMETERS, Forecaster, parameter_table
from seriesloom.plans import competition


class Drift:
    """Last value plus the mean step; complains about what it cannot do."""

    def __init__(self, damping=1.0):
        self.damping = damping

    def fit(self, series):
        if series.name == "never" or not isinstance(series.index, pd.DatetimeIndex):
            raise TypeError("not a dated series")
        if (series < 0).any():
            raise ValueError(f"negative at {series.idxmin():%Y-%m}")
        self.last, self.step = series.iloc[-1], series.diff().mean() * self.damping

    def predict(self, steps):
        if self.last == 0:
            return [1.0]
        return self.last + self.step * np.arange(1, steps + 1)

    def get_params(self):
        return {"damping": self.damping, "step": self.step}


@pytest.fixture
def drift():
    per_series.register_series_model("drift", Drift, lambda damping=1.0: {"damping": str(damping)})
    yield
    MODELS.pop("drift")
    PARAMETERS.pop("drift")


def test_one_poisoned_series_of_a_thousand(spark, drift):
    dates = month_ends(2019, 1, 24)
    rows = [(f"s{k}", d, float(k + 3 * i)) for k in range(1, 1000) for i, d in enumerate(dates)]
    rows += [("bad", d, -1.0 if i == 5 else 2.0) for i, d in enumerate(dates)]
    panel = spark.createDataFrame(rows, "state string, date date, total double")
    outcome = competition.compete(panel, ["drift"])
    assert outcome.records.count() == 999 and [r.state for r in outcome.failed.collect()] == ["bad"]
    failures = outcome.failures.collect()
    assert {(r.state, r.phase, r.model, r.reason) for r in failures} == {("bad", p, "drift", "ValueError: negative at 2019-06") for p in ("val", "future")}
    point = outcome.records.filter("state = 's7'").first()
    assert [p.value for p in point.forecast] == [7.0 + 3 * 24, 7.0 + 3 * 25] and point.metrics[0].mae == pytest.approx(0)


def test_a_class_competes_beside_the_other_models(spark, drift, long_panel):
    outcome = competition.compete(long_panel, ["seasonal_naive", "linear_trend", "drift"], settings={"drift": {"damping": 0.5}})
    records = {r.state: r for r in outcome.records.collect()}
    assert set(records["wave"].all_forecasts) == {"seasonal_naive", "linear_trend", "drift"}
    assert records["line"].best_model == "linear_trend" and outcome.failures.count() == 0
    got = Forecaster("drift", damping=0.0).fit(long_panel).predict(2).filter("state = 'line'").collect()
    assert [r.yhat for r in got] == [100 + 2.0 * 83] * 2
    assert parameter_table(spark).filter("model = 'drift'").first().params == {"damping": "1.0"}


def test_wrong_output_is_a_reason_and_parameters_are_per_series(spark, long_panel):
    zero = spark.createDataFrame([("zero", d, 0.0) for d in month_ends(2017, 1, 84)], long_panel.schema)
    frame = phase_frame(long_panel.unionByName(zero), (FUTURE,))
    made = per_series.forecast_each("drift", Drift, frame)
    assert {r.state: r.error for r in made.filter("error is not null").collect()} == {"zero": "2 finite numbers were asked for, the model gave [1.0]"}
    params = {r.state: r.params for r in per_series.series_parameters("drift", Drift, frame).collect()}
    assert set(params) == {"grow", "wave", "line"} and params["line"] == {"damping": "1.0", "step": "2.0"}
    nothing = per_series.fit_each(frame.limit(0), Drift)
    assert nothing.count() == 0


def test_no_shuffle_between_the_frame_and_the_objects(spark, long_panel):
    from seriesloom.operators.panel import build_monthly_panel

    frame = phase_frame(build_monthly_panel(long_panel), (FUTURE,))
    of = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert of(per_series.fit_each(frame, Drift)) == of(frame)


def test_solvers_name_the_reason_of_each_series(spark, long_panel):
    dates = month_ends(2017, 1, 84)
    bad = [("endless", d, float("inf")) for d in dates]
    panel = long_panel.unionByName(spark.createDataFrame(bad, long_panel.schema))
    outcome = competition.compete(panel, ["trend_seasonal", "seasonal_ar"])
    told = {(r.state, r.model): r.reason for r in outcome.failures.collect()}
    assert told["endless", "trend_seasonal"] == "its values or design are not finite"
    assert told["endless", "seasonal_ar"].startswith("no order could be fitted: ") and "72" in told["endless", "seasonal_ar"]
    assert {s for s, _ in told} == {"endless"} and outcome.records.count() == 3
    assert "error" not in seasonal_ar.fit(phase_frame(long_panel)).columns
