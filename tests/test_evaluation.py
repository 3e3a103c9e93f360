import datetime

import pytest

from seriesloom.operators import evaluation
from seriesloom.plans import records as rec
from seriesloom.plans import serving

SCHEMA = "state string, model string, phase string, step int, date date, yhat double, y double"
D = datetime.date


def predictions(spark, rows):
    return spark.createDataFrame([(s, m, "val", i + 1, D(2020, i + 1, 28), float(p), float(y)) for s, m, i, p, y in rows], SCHEMA)


def series(state, model, yhat, y):
    return [(state, model, i, p, a) for i, (p, a) in enumerate(zip(yhat, y))]


def test_metric_values(spark):
    got = evaluation.score_models(predictions(spark, series("A", "m", [110, 190], [100, 200]))).first()
    assert (got.mae, got.rmse, got.mape, got.smape) == (10.0, 10.0, 7.5, 7.326)


def test_percentage_error_of_zero_actuals_is_missing(spark):
    got = evaluation.score_models(predictions(spark, series("A", "m", [1, 2, 3], [0, 0, 0]))).first()
    assert got.mape is None and got.smape == 200.0


def test_perfect_model_wins(spark):
    y = [100, 200, 300]
    rows = series("A", "B", [200, 100, 150], y) + series("A", "A", y, y)
    best = evaluation.best_model(evaluation.score_models(predictions(spark, rows)), ["A", "B"]).first()
    assert best.best_model == "A"


def test_ties_go_to_rmse_then_competition_order(spark):
    metrics = spark.createDataFrame(
        [
            ("A", "x", 1.0, 5.0, 2.0, 1.0), ("A", "y", 1.0, 4.0, 2.0, 1.0), ("A", "z", 1.0, 1.0, None, 1.0),
            ("B", "y", 1.0, 4.001, 2.0, 1.0), ("B", "x", 1.0, 4.004, 2.0, 1.0),
        ],
        "state string, model string, mae double, rmse double, mape double, smape double",
    )
    got = {r.state: r.best_model for r in evaluation.best_model(metrics, ["x", "y", "z"]).collect()}
    assert got == {"A": "y", "B": "x"}
    other = {r.state: r.best_model for r in evaluation.best_model(metrics, ["x", "y", "z"], "rmse").collect()}
    assert other["A"] == "z"


def test_no_metrics_no_winner(spark):
    empty = spark.createDataFrame([], "state string, model string, mae double, rmse double, mape double, smape double")
    assert evaluation.best_model(empty, ["x"]).count() == 0


@pytest.fixture(scope="module")
def records(spark):
    y = [10.0, 20.0, 30.0]
    rows = predictions(
        spark,
        series("California", "A", y, y) + series("California", "B", [11, 21, 31], y)
        + series("Texas", "A", [0, 0, 0], y) + series("Texas", "B", [9, 19, 29], y)
        + series("texas", "A", y, y),
    )
    future = [
        (s, m, "future", i + 1, D(2020, i + 4, 28), v + i, None)
        for s, m, v in [("California", "A", 1.005), ("California", "B", 2.0), ("Texas", "A", 3.0), ("Texas", "B", 4.0), ("texas", "A", 5.0), ("Ghost", "A", 6.0)]
        for i in range(2)
    ]
    return rec.forecast_records(rows.unionByName(spark.createDataFrame(future, SCHEMA)), ["A", "B"]).cache()


def test_records_equal_the_stepwise_operators(spark, records):
    got = {r.state: r for r in records.collect()}
    assert {s: r.best_model for s, r in got.items()} == {"California": "A", "Texas": "B", "texas": "A"}
    assert [m.model for m in got["California"].metrics] == ["A", "B"]
    assert [p.value for p in got["Texas"].forecast] == [4.0, 5.0]
    assert set(got["California"].all_forecasts) == {"A", "B"}
    assert [p.value for p in got["Texas"].validation] == [10.0, 20.0, 30.0]


def test_states_without_scores_failed(spark, records):
    targets = spark.createDataFrame([("California",), ("Ghost",)], "state string")
    assert [r.state for r in rec.failed_states(targets, records).collect()] == ["Ghost"]


def test_leaderboard_counts_wins_and_averages_all_states(records):
    board = {r.model: r for r in evaluation.leaderboard(rec.record_metrics(records)).collect()}
    assert (board["A"].wins, board["A"].win_pct, board["A"].total_states) == (2, 66.7, 3)
    assert board["A"].avg_val_mape == 33.33 and board["B"].wins == 1


def test_lookup_prefers_exact_names(spark, records):
    asked = spark.createDataFrame([("texas",), ("TEXAS",), ("california",), ("Narnia",), ("Narnia",)], "request string")
    got = {r.request: r.state for r in serving.lookup_states(asked, records).collect()}
    assert got == {"texas": "texas", "TEXAS": "Texas", "california": "California", "Narnia": None}


def test_responses_echo_the_request(spark, records):
    asked = spark.createDataFrame([("california",)], "request string")
    row = serving.forecast_response(asked, records).first()
    assert row.state == "california" and row.forecast_steps == 2 and len(row.forecast) == 2


def test_batch_splits_found_and_missing(spark, records):
    asked = spark.createDataFrame([("California",), ("Narnia",)], "request string")
    rows = serving.batch_lookup(asked, records).collect()
    assert sorted(r.step for r in rows if r.request == "California") == [1, 2]
    missing = [r for r in rows if r.request == "Narnia"]
    assert len(missing) == 1 and missing[0].error == "'Narnia' not found. GET /states for list." and missing[0].date is None


def test_history_length_is_checked(sample_panel, records):
    for n in (2, 121):
        with pytest.raises(ValueError):
            serving.history_view(sample_panel, records, n)


def test_history_is_followed_by_the_forecast(spark, records):
    rows = [("California", D(2020, m, 28), float(m)) for m in range(1, 7)]
    panel = spark.createDataFrame(rows, "state string, date date, total double")
    got = serving.history_of(panel, records, "CALIFORNIA", 3).orderBy("kind", "date").collect()
    assert [(r.kind, r.value) for r in got if r.kind == "history"] == [("history", 4.0), ("history", 5.0), ("history", 6.0)]
    assert len([r for r in got if r.kind == "forecast"]) == 2


def test_health_and_state_list(records):
    assert serving.health(records).first().states_loaded == 3
    assert [r.state for r in serving.list_states(records).collect()] == ["California", "Texas", "texas"]


def test_zip_points_stops_at_the_shorter_array(spark):
    df = spark.createDataFrame([("A", ["d1", "d2", "d3"], [1.0, 2.0])], "state string, dates array<string>, vals array<double>")
    got = [(r.step, r.date, r.value) for r in rec.zip_points(df, "dates", "vals").orderBy("step").collect()]
    assert got == [(1, "d1", 1.0), (2, "d2", 2.0)]


def test_leaderboard_ties_follow_the_competition(spark):
    y = [10.0, 20.0, 30.0]
    rows = predictions(spark, series("S", "B", y, y) + series("S", "A", [1, 2, 3], y) + series("T", "A", y, y) + series("T", "B", [1, 2, 3], y))
    ranked = evaluation.rank_models(evaluation.score_models(rows), ["B", "A"])
    assert [(r.model, r.wins) for r in evaluation.leaderboard(ranked).collect()] == [("B", 1), ("A", 1)]


def test_actuals_are_attached_by_state_and_step(spark):
    rows = predictions(spark, series("S", "A", [1.0, 2.0], [0.0, 0.0]))
    actuals = spark.createDataFrame([("S", 1, 5.0), ("S", 2, 7.0), ("T", 1, 9.0)], "state string, step int, y double")
    got = evaluation.attach_actuals(rows, actuals).orderBy("step").collect()
    assert [(r.step, r.yhat, r.y) for r in got] == [(1, 1.0, 5.0), (2, 2.0, 7.0)]


def test_an_empty_store_is_an_error(spark, records):
    assert serving.loaded(records).count() == 3
    with pytest.raises(serving.EmptyStore):
        serving.loaded(records.filter("state = 'none'"))


def test_lookup_ranks_narrow_rows(spark, records):
    """The requests are the small side of both joins; records take part once, at the end."""
    asked = spark.createDataFrame([("texas",)], "request string")
    plan = serving.lookup_states(asked, records)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct" in plan and "min_by" not in plan
