import numpy as np
import pytest
from months import month_ends
from pyspark.sql import functions as F

from seriesloom.models import baselines, gbt_lag, seasonal_ar, trend_seasonal, window_huber
from seriesloom.models.frame import FUTURE, PHASES, VALIDATION, phase_frame
from seriesloom.models.least_squares import design_rows, explosive, ridge_coefficients, solve_stacked
from seriesloom.models.registry import MODELS, Forecaster, parameter_table, register
from seriesloom.operators import evaluation, panel as panels
from seriesloom.plans import competition, records as rec
from seriesloom.sources import store as stores


@pytest.fixture(scope="module")
def frame(long_panel):
    return phase_frame(long_panel).cache()


def check_shape(made, states=3):
    rows = made.collect()
    assert len(rows) == states * (VALIDATION.steps + FUTURE.steps)
    assert min(r.yhat for r in rows) >= 0
    assert all((r.y is not None) == (r.phase == "val") for r in rows)
    return {(r.state, r.phase, r.step): r for r in rows}


def mape(made):
    return {r.state: r.mape for r in evaluation.score_models(made).collect()}


def test_naive_repeats_last_year(frame, long_panel):
    got = check_shape(baselines.seasonal_naive(frame))
    values = [r.total for r in long_panel.filter("state = 'wave'").orderBy("date").collect()]
    assert [got["wave", "val", s].yhat for s in range(1, 7)] == values[66:72]
    assert [got["wave", "future", s].yhat for s in (1, 2)] == values[72:74]


def test_line_is_recovered(frame):
    got = check_shape(baselines.linear_trend(frame))
    np.testing.assert_allclose([got["line", "future", s].yhat for s in (1, 2)], [100 + 2 * 84, 100 + 2 * 85])


def test_both_baselines_in_one_pass_equal_the_single_ones(frame):
    both = {(r.state, r.model, r.phase, r.step): r.yhat for r in baselines.baseline_predictions(frame).collect()}
    single = baselines.seasonal_naive(frame).unionByName(baselines.linear_trend(frame))
    assert both == {(r.state, r.model, r.phase, r.step): r.yhat for r in single.collect()}


def test_grouped_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(60, 2)), rng.normal(size=60)
    y = 1 + x @ [2.0, -3.0] + 0.1 * noise
    rows = [("A", float(a), float(b), float(t)) for (a, b), t in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, a double, b double, t double")
    designs = df.groupBy("k").agg(design_rows(["1D", "a", "b"], "t", "true", "designs"))
    got = designs.select(ridge_coefficients(F.col("designs"), [0.0, 0.0, 0.0]).alias("c")).first().c
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_stacked_solver_reports_the_residual_sum():
    x = np.column_stack([np.ones(10), np.arange(10.0)])
    y = np.arange(10.0) ** 2
    joined = np.column_stack([x, y])
    b, sse = solve_stacked((joined.T @ joined)[None], np.arange(2), np.zeros(2))
    want = np.linalg.lstsq(x, y, rcond=None)
    np.testing.assert_allclose(b[0], want[0], rtol=1e-5)
    np.testing.assert_allclose(sse[0], want[1][0], rtol=1e-6)


def test_explosive_dynamics_are_told_from_stable_ones():
    weights = np.array([[0.5, 0.3, 0.0], [1.5, -0.7, 0.0], [1.0, 0.0, 0.0], [1.1, 0.0, 0.0], [0.0, 0.0, 1.2], [2.0, -0.9, 0.2]])
    roots = []
    for a in weights:
        companion = np.eye(12, k=-1)
        companion[0, [0, 1, 11]] = a
        roots.append(np.abs(np.linalg.eigvals(companion)).max())
    assert explosive(weights, (1, 2, 12)).tolist() == [r > 1.001 for r in roots]


def test_short_bursts_do_not_explode(spark):
    """Lines with a late jump tempt an unbounded fit; the forecast stays near the data."""
    rows = []
    for i in range(6):
        values = np.concatenate([np.linspace(10, 12, 60), 12 * 1.25 ** np.arange(1, 7 + i)])
        rows += [(f"S{i}", d, float(v)) for d, v in zip(month_ends(2015, 1, len(values)), values)]
    panel = spark.createDataFrame(rows, "state string, date date, total double")
    made = seasonal_ar.forecast(phase_frame(panel, (FUTURE,))).collect()
    top = {r.state: r.top for r in panel.groupBy("state").agg(F.max("total").alias("top")).collect()}
    assert len(made) == 12 and all(r.yhat < 3 * top[r.state] for r in made)


def test_seasonal_ar_follows_the_season(frame):
    made = seasonal_ar.forecast(frame)
    check_shape(made)
    assert max(mape(made).values()) < 2


def test_order_search_returns_one_order_per_series(frame):
    rows = seasonal_ar.order_search(frame).collect()
    assert len(rows) == 6
    assert all(r.p in (0, 1, 2) and r.q in (0, 1, 2) and r.d in (0, 1) and r.season == 12 for r in rows)


def test_candidate_table_has_72_orders(spark):
    tested = spark.createDataFrame([("A", True), ("B", False)], "state string, stationary boolean")
    rows = seasonal_ar.order_candidates(tested).collect()
    assert len(rows) == 144 and {(r.state, r.d) for r in rows} == {("A", 0), ("B", 1)}
    assert len({(r.p, r.q, r.sp, r.sd, r.sq) for r in rows}) == 72


def test_short_series_use_the_short_search(spark):
    rng = np.random.default_rng(1)
    rows = [("S", d, float(v)) for d, v in zip(month_ends(2020, 1, 20), 100 + rng.normal(size=20))]
    rows += [("tiny", d, 1.0) for d in month_ends(2020, 1, 9)]
    frame = phase_frame(spark.createDataFrame(rows, "state string, date date, total double"), (FUTURE,))
    made = seasonal_ar.forecast(frame).collect()
    assert {r.state for r in made} == {"S"} and len(made) == 2
    np.testing.assert_allclose([r.yhat for r in made], 100, atol=5)
    assert [(r.state, r.model) for r in seasonal_ar.skipped_series(frame).collect()] == [("tiny", "seasonal_ar")]


def test_fitted_values_are_close_on_a_clean_series(frame):
    rows = seasonal_ar.fitted_values(frame).filter("state = 'wave' and phase = 'future'").collect()
    assert len(rows) >= 48
    assert np.mean([abs(r.fitted / r.total - 1) for r in rows]) < 0.02


def test_trend_seasonal_recovers_season_and_growth(frame):
    made = trend_seasonal.forecast(frame)
    check_shape(made)
    assert max(mape(made).values()) < 8


def test_components_add_up_to_history(frame):
    rows = trend_seasonal.components(frame).filter("phase = 'future' and state = 'wave'").collect()
    assert len(rows) == 84
    assert np.mean([abs(r.yhat / r.total - 1) for r in rows]) < 0.03


def test_gbt_lag_tracks_seasonal_series(frame):
    made = gbt_lag.forecast(frame, PHASES, max_iterations=40)
    check_shape(made)
    assert mape(made)["wave"] < 25


def test_gbt_is_deterministic_and_ranks_features(frame, tmp_path):
    first = gbt_lag.fit(frame, "val", 5)
    again = gbt_lag.fit(frame, "val", 5)
    one = {(r.state, r.step): r.yhat for r in gbt_lag.predict(frame, VALIDATION, first).collect()}
    assert one == {(r.state, r.step): r.yhat for r in gbt_lag.predict(frame, VALIDATION, again).collect()}
    importance = gbt_lag.feature_importance(first, frame).collect()
    assert len(importance) == 18 and abs(sum(r.importance for r in importance) - 1) < 1e-9
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)
    gbt_lag.save(first, str(tmp_path / "gbt"))
    loaded = gbt_lag.load(str(tmp_path / "gbt"))
    assert one == {(r.state, r.step): r.yhat for r in gbt_lag.predict(frame, VALIDATION, loaded).collect()}


def test_window_huber_follows_the_season(frame):
    made = window_huber.forecast(frame, PHASES)
    check_shape(made)
    assert mape(made)["wave"] < 5


def test_lookback_is_half_the_series_up_to_twelve(spark, long_panel):
    """Short series share a model among themselves, so a group of them is fitted well."""
    rng = np.random.default_rng(5)
    rows = [
        (f"short{i}", d, float(v))
        for i in range(20)
        for d, v in zip(month_ends(2022, 1, 16), 50 + rng.normal(size=16))
    ]
    rows += [("tiny", d, 1.0) for d in month_ends(2022, 1, 3)]
    mixed = long_panel.unionByName(spark.createDataFrame(rows, long_panel.schema))
    frame = phase_frame(mixed, (FUTURE,)).cache()
    assert window_huber.lookbacks(frame) == {"future": [8, 12]}
    made = window_huber.forecast(frame, (FUTURE,)).collect()
    assert {"grow", "wave", "line"} < {r.state for r in made} and len(made) == 46
    np.testing.assert_allclose([r.yhat for r in made if r.state.startswith("short")], 50, atol=5)
    row = window_huber.skipped_series(frame).first()
    assert (row.state, row.reason) == ("tiny", "3 points, a lookback window needs at least 4")


@pytest.mark.parametrize("name", ["seasonal_ar", "trend_seasonal", "window_huber", "gbt_lag"])
def test_facade_forecasts_two_months(sample_panel, name):
    settings = {"max_iterations": 20} if name == "gbt_lag" else {}
    rows = Forecaster(name, **settings).fit(sample_panel).predict(2).collect()
    assert sorted(r.step for r in rows) == [1, 2] and all(r.yhat >= 0 for r in rows)


def test_predict_before_fit_raises():
    with pytest.raises(RuntimeError):
        Forecaster("seasonal_ar").predict(2)
    assert "candidates" in Forecaster("seasonal_ar").get_params()


def test_competition_stores_and_resumes(spark, long_panel, tmp_path):
    path = str(tmp_path / "store")
    names = ["seasonal_naive", "linear_trend", "trend_seasonal"]
    first = competition.compete(long_panel, names, request=["wave", "line"], store_path=path)
    best = {r.state: r.best_model for r in first.records.collect()}
    assert set(best) == {"wave", "line"} and best["line"] == "linear_trend"
    assert best["wave"] == "seasonal_naive"
    stored = stores.read_records(spark, path)
    second = competition.compete(long_panel, names, store=stored, store_path=path)
    assert {r.state for r in second.records.collect()} == {"grow"}
    assert stores.read_records(spark, path).count() == 3
    stores.export_json(stores.read_records(spark, path), str(tmp_path / "json"))
    back = {r.state: r for r in stores.import_json(spark, str(tmp_path / "json")).collect()}
    assert back["line"].best_model == "linear_trend" and len(back["line"].forecast) == 2


def test_saved_fits_forecast_like_fresh_ones(spark, long_panel, tmp_path):
    path = str(tmp_path / "fits")
    competition.save_fits(long_panel, path, {"gbt_lag": {"max_iterations": 7}})
    frame = phase_frame(long_panel, (FUTURE,))
    for model in (seasonal_ar, trend_seasonal):
        stored = model.predict(spark.read.parquet(f"{path}/{model.NAME}"))
        got = {(r.state, r.step): r.yhat for r in stored.collect()}
        want = {(r.state, r.step): r.yhat for r in model.forecast(frame).collect()}
        assert got.keys() == want.keys() and len(got) == 6
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-6)
    assert gbt_lag.load(f"{path}/gbt_lag").getNumTrees == 7
    assert (tmp_path / "fits" / "window_huber" / "12").is_dir()


def test_parameters_are_a_table(spark):
    rows = {r.model: r.params for r in parameter_table(spark).collect()}
    assert set(rows) == {"seasonal_ar", "trend_seasonal", "gbt_lag", "window_huber"}
    assert rows["gbt_lag"]["maxDepth"] == "4"


def test_store_path_can_be_named_by_the_environment(monkeypatch):
    assert stores.store_path("a") == "a"
    monkeypatch.setenv("FORECASTS_PATH", "b")
    assert stores.store_path("a") == "b"


def test_one_broken_model_does_not_stop_the_others(spark, long_panel):
    """Broken while its plan is built, or while it runs; short and unknown states get a reason too."""

    def broken(frame, phases):
        raise ValueError("no luck" * 200)

    def broken_later(frame, phases):
        made = MODELS["linear_trend"](frame, phases)
        return made.withColumn("yhat", F.expr("if(yhat is null, 0D, raise_error('no luck at run time'))"))

    short = spark.createDataFrame([("short", d, 1.0) for d in month_ends(2022, 1, 12)], long_panel.schema)
    register("broken", broken)
    register("broken_later", broken_later)
    try:
        names = ["linear_trend", "broken", "broken_later"]
        panel = long_panel.unionByName(short)
        outcome = competition.compete(panel, names, request=["wave", "line", "short", "nowhere"])
        assert {r.state for r in outcome.records.collect()} == {"wave", "line"}
        assert {r.state for r in outcome.failed.collect()} == {"short", "nowhere"}
        reasons = {r.model or r.state: r.reason for r in outcome.failures.collect()}
        assert set(reasons) == {"broken", "broken_later", "short", "nowhere"}
        assert reasons["broken"] == "no luck" * 200 and "no luck at run time" in reasons["broken_later"]
        assert reasons["short"].startswith("6 training months") and reasons["nowhere"] == "not in the panel"
    finally:
        MODELS.pop("broken")
        MODELS.pop("broken_later")


def test_a_series_without_a_solution_leaves_the_others(spark, long_panel):
    bad = [("bad", d, float("inf")) for d in month_ends(2017, 1, 84)]
    panel = long_panel.unionByName(spark.createDataFrame(bad, long_panel.schema))
    outcome = competition.compete(panel, ["trend_seasonal", "seasonal_ar"])
    assert {r.state for r in outcome.records.collect()} >= {"grow", "wave", "line"}
    failed = {(r.state, r.model, r.reason) for r in outcome.failures.collect()}
    assert ("bad", "trend_seasonal", "its values or design are not finite") in failed


def test_settings_reach_the_models(spark, long_panel):
    outcome = competition.compete(long_panel, ["gbt_lag", "seasonal_ar"], settings={"gbt_lag": {"max_iterations": 3}, "seasonal_ar": {"bounded": True}})
    assert outcome.records.count() == 3
    assert Forecaster("trend_seasonal", fourier_order=2).get_params()["yearly_seasonality"] == "2"
    table = {r.model: r.params for r in parameter_table(spark, {"gbt_lag": {"max_iterations": 3}}).collect()}
    assert table["gbt_lag"]["max_iterations"] == "3" and parameter_table(spark).filter("model = 'gbt_lag'").first().params["max_iterations"] == "300"


def order_frame(spark):
    """Series of 20, 36, 37 and 80 points, and one that grows by 3 % a month."""
    at = np.arange(80)
    season = 100 + 10 * np.sin(np.pi * at / 6) + at / 2 + (at * 7919 % 13) / 5
    rows = [(f"n{n}", d, float(v)) for n in (20, 36, 37, 80) for d, v in zip(month_ends(2015, 1, n), season)]
    rows += [("grow", d, float(100 * 1.03**i)) for i, d in enumerate(month_ends(2015, 1, 80))]
    return phase_frame(spark.createDataFrame(rows, "state string, date date, total double"), (FUTURE,)).cache()


def test_every_order_has_a_score_or_a_reason(spark):
    frame = order_frame(spark)
    rows = seasonal_ar.order_scores(frame).collect()
    scored = {s: sum(r.aic is not None for r in rows if r.state == s) for s in ("n20", "n36", "n37", "n80", "grow")}
    assert len(rows) == 5 * 72 and scored == {"n20": 9, "n36": 72, "n37": 72, "n80": 72, "grow": 72}
    assert {r.reason for r in rows if r.aic is None} == {"too few rows"}
    bounded = seasonal_ar.order_scores(frame, bounded=True).filter("state = 'grow'").collect()
    assert any(r.reason == "explosive" for r in bounded)
    best = {r.state: r.aic for r in seasonal_ar.order_search(frame).collect()}
    assert all(best[s] == min(r.aic for r in rows if r.state == s and r.aic is not None) for s in best)
    made = {r.step: r.yhat for r in seasonal_ar.forecast(frame).filter("state = 'grow'").collect()}
    np.testing.assert_allclose([made[1], made[2]], [100 * 1.03**80, 100 * 1.03**81], rtol=1e-4)


def test_the_chosen_order_is_fitted_on_every_row_it_can_use(spark):
    frame = order_frame(spark)
    chosen = {r.state: r for r in seasonal_ar.order_search(frame).collect()}
    counts = {r.state: r["count"] for r in seasonal_ar.fitted_values(frame).groupBy("state").count().collect()}
    for state, n in (("n20", 20), ("n36", 36), ("n37", 37), ("n80", 80), ("grow", 80)):
        r = chosen[state]
        assert counts[state] == n - r.d - 12 * r.sd - max(r.p, 12 * r.sp)
    params = seasonal_ar.series_parameters(frame).filter("state = 'n80'").first().params
    assert set(params) == {"order", "seasonal_order", "aic"} and params["seasonal_order"].endswith(", 12)")


def test_the_newest_run_is_read(spark, long_panel, tmp_path):
    path = str(tmp_path / "twice")
    for names in (["seasonal_naive"], ["linear_trend"]):
        competition.compete(long_panel, names, store_path=path)
    assert {r.best_model for r in stores.read_records(spark, path).collect()} == {"linear_trend"}


def test_chart_rows_cover_all_kinds(spark, long_panel):
    split = panels.train_val_split(long_panel)
    made = rec.forecast_records(baselines.baseline_predictions(phase_frame(long_panel)), ["seasonal_naive", "linear_trend"])
    counts = {r.kind: r["count"] for r in rec.chart_frame(split, made).groupBy("kind").count().collect()}
    assert counts == {"train": 3 * 78, "val": 18, "val_forecast": 36, "forecast": 6}
