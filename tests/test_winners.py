import numpy as np
import pytest
from months import month_ends

from seriesloom.models import window_huber
from seriesloom.models.frame import FUTURE, VALIDATION, phase_frame
from seriesloom.models.registry import MODELS, Forecaster
from seriesloom.plans import competition, winners
from seriesloom.plans.records import forecast_points

NAMES = ["seasonal_ar", "trend_seasonal", "gbt_lag", "window_huber", "seasonal_naive", "linear_trend"]
SETTINGS = {"gbt_lag": {"max_iterations": 20}, "trend_seasonal": {"fourier_order": 3, "sparse": True}}


@pytest.fixture(scope="module")
def panel(spark):
    """Six series of 60 months with trend, season and noise."""
    at, rng = np.arange(60), np.random.default_rng(2)
    values = {f"s{i}": 1000 + 3 * i * at + 50 * i * np.sin(np.pi * at / 6) + 20 * rng.normal(size=60) for i in range(6)}
    rows = [(s, d, float(v)) for s, many in values.items() for d, v in zip(month_ends(2018, 1, 60), many)]
    return spark.createDataFrame(rows, "state string, date date, total double").cache()


def record_table(spark, chosen):
    return spark.createDataFrame(list(chosen.items()), "state string, best_model string")


def points(df):
    return {(r.state, r.best_model, r.step, r.date): r.value for r in df.collect()}


def test_every_model_forecasts_from_the_store_what_it_forecast_in_the_competition(spark, panel, tmp_path):
    path, records = str(tmp_path / "winners"), record_table(spark, {f"s{i}": name for i, name in enumerate(NAMES)})
    winners.store_winners(panel, records, path, SETTINGS)
    got = points(winners.forecast_from_store(spark, path))
    made = competition.compete(panel, NAMES, settings=SETTINGS).predictions.filter("phase = 'future'")
    want = points(made.withColumnRenamed("model", "best_model").withColumnRenamed("yhat", "value").join(records, ["state", "best_model"]))
    assert got.keys() == want.keys() and len(got) == 12
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12 if key[1] != "window_huber" else 1e-6), key
    stored = winners.read_winners(spark, path).collect()
    assert {r.state: r.model for r in stored} == {f"s{i}": name for i, name in enumerate(NAMES)}
    filled = {r.model: [c for c in r.asDict() if c.startswith("fit_") and r[c] is not None] for r in stored}
    assert filled == {name: [f"fit_{name}"] for name in NAMES}
    params = {r.model: r.params for r in stored}
    assert all(params[name] for name in NAMES) and params["gbt_lag"]["max_iterations"] == "20"
    assert params["seasonal_ar"]["order"].startswith("(") and params["trend_seasonal"]["yearly_seasonality"] == "3"


def test_the_winners_of_a_competition_equal_its_best_forecasts(spark, panel, tmp_path):
    path, settings = str(tmp_path / "winners"), {"seasonal_ar": {"product": True}}
    outcome = competition.compete(panel, ["seasonal_ar", "trend_seasonal", "linear_trend"], settings=settings)
    winners.store_winners(panel, outcome.records, path, settings)
    got = {k: round(v, 2) for k, v in points(winners.forecast_from_store(spark, path)).items()}
    assert got == pytest.approx(points(forecast_points(outcome.records)), abs=0.011) and len(got) == 12
    used = {r.kind for r in winners.read_winners(spark, path).collect()}
    assert used <= {"seasonal_product", "trend_seasonal", "linear_trend"}


def test_the_horizon_may_be_longer_than_the_stored_one(spark, panel, tmp_path):
    path = str(tmp_path / "winners")
    winners.store_winners(panel, record_table(spark, {"s1": "linear_trend", "s2": "trend_seasonal"}), path)
    got = points(winners.forecast_from_store(spark, path, steps=9))
    assert len(got) == 18
    for state, name in (("s1", "linear_trend"), ("s2", "trend_seasonal")):
        fresh = Forecaster(name).fit(panel.filter(f"state = '{state}'")).predict(9).collect()
        for r in fresh:
            assert got[state, name, r.step, r.date] == pytest.approx(r.yhat, rel=1e-12)


def test_records_without_a_usable_winner(spark, panel, tmp_path):
    records = record_table(spark, {"s1": "linear_trend", "s2": None, "elsewhere": "linear_trend"})
    winners.store_winners(panel, records, str(tmp_path / "some"))
    assert {k[0] for k in points(winners.forecast_from_store(spark, str(tmp_path / "some")))} == {"s1"}
    with pytest.raises(ValueError, match="no state has a best model"):
        winners.winning_fits(panel, record_table(spark, {"s1": None}))
    with pytest.raises(ValueError, match="cannot be stored"):
        winners.winning_fits(panel, record_table(spark, {"s1": "mine"}))
    with pytest.raises(ValueError, match="no fit per series"):
        winners.winning_fits(panel, record_table(spark, {"s1": "gbt_lag"}), {"gbt_lag": {"pooled": True}})
    assert set(winners.KINDS) >= set(NAMES) and set(NAMES) <= set(MODELS)


def test_a_reader_opens_only_the_kinds_it_needs(spark, panel, tmp_path):
    path = str(tmp_path / "winners")
    winners.store_winners(panel, record_table(spark, {"s1": "linear_trend", "s2": "seasonal_naive"}), path)
    one = winners.read_winners(spark, path).filter("kind = 'linear_trend'")
    plan = winners.forecast_winners(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "fit_seasonal_naive" not in plan


def test_a_stronger_penalty_wins_on_noise(spark):
    """Windows of pure noise: whatever is learnt on the inner part does harm on the tail."""
    rng = np.random.default_rng(4)
    rows = [(f"n{i}", d, float(v)) for i in range(3) for d, v in zip(month_ends(2015, 1, 40), 100 + rng.normal(size=40))]
    frame = phase_frame(spark.createDataFrame(rows, "state string, date date, total double"), (VALIDATION, FUTURE)).cache()
    path = {r.penalty: r for r in window_huber.penalty_path(frame, (FUTURE,)).collect()}
    assert sorted(path) == list(window_huber.PATH) and sum(r.chosen for r in path.values()) == 1
    best = next(r for r in path.values() if r.chosen)
    assert best.penalty > window_huber.PENALTY and best.error == min(r.error for r in path.values())
    assert {r.n_held_out for r in path.values()} == {3 * max(1, int((40 - 12) * 0.2))}
    model = window_huber.fit(frame, FUTURE.name, penalties=window_huber.PATH)
    assert model.getRegParam() == best.penalty
    assert window_huber.forecast(frame, (FUTURE,), penalties=window_huber.PATH).count() == 6


def test_a_tie_takes_the_stronger_penalty_and_no_rows_leave_the_default():
    assert window_huber.chosen([(0.1, 5, 2.0), (1.0, 5, 2.0), (0.01, 5, 3.0)], 7.0) == 1.0
    assert window_huber.chosen([(0.1, 0, None), (1.0, 0, None)], 7.0) == 7.0
