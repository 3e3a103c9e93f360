import numpy as np
import pytest
from months import month_ends

from seriesloom.models import seasonal_product as product
from seriesloom.models.frame import FUTURE, phase_frame
from seriesloom.models.registry import Forecaster
from seriesloom.models.seasonal_ar import CANDIDATES
from seriesloom.plans import competition

TRUE = np.array([[3.0, 0.5, 0.0, 0.4, 0.0, 0.6, 0.35]])


@pytest.fixture(scope="module")
def simulated():
    """2,000 values of the order (1, 1) x (1, 1), each worked out from the polynomials one factor at a time."""
    shocks = np.random.default_rng(11).normal(size=2100)
    seasonal = [shocks[t] + (0.35 * shocks[t - 12] if t >= 12 else 0) for t in range(2100)]
    moved = [seasonal[t] + (0.4 * seasonal[t - 1] if t else 0) for t in range(2100)]
    outer, u = [], []
    for t in range(2100):
        outer.append(moved[t] + (0.6 * outer[t - 12] if t >= 12 else 0))
        u.append(outer[t] + (0.5 * u[t - 1] if t else 0))
    return 3.0 + np.array(u[100:])


def test_residuals_equal_one_step_after_another():
    w, params = np.random.default_rng(1).normal(size=40), np.array([[0.3, 0.5, -0.2, 0.4, 0.1, 0.6, -0.3]])
    u = w - 0.3

    def back(x, t, k):
        return x[t - k] if t >= k else 0.0

    outer = [u[t] - 0.6 * back(u, t, 12) for t in range(40)]
    inner = [outer[t] - 0.5 * back(outer, t, 1) + 0.2 * back(outer, t, 2) for t in range(40)]
    middle, e = [], []
    for t in range(40):
        middle.append(inner[t] - 0.4 * back(middle, t, 1) - 0.1 * back(middle, t, 2))
        e.append(middle[t] + 0.3 * back(e, t, 12))
    np.testing.assert_allclose(product.residuals(w, params)[0], e, rtol=1e-9, atol=1e-12)


def test_known_coefficients_are_found_again(simulated):
    found = product.search(simulated, 0)
    at = CANDIDATES.index((1, 1, 1, 0, 1))
    np.testing.assert_allclose(found[at]["params"], TRUE[0], atol=0.08, rtol=0.1)
    assert found[at]["sse"] <= product.sum_of_squares(product.residuals(simulated, TRUE))[0]
    best = product.choose(found)
    assert best["sd"] == 0 and best["aic"] <= found[at]["aic"]


def test_no_order_ends_above_its_start_and_steps_end_at_a_stationary_point(simulated):
    w = simulated[:120]
    active = product.ACTIVE[product.SEASONAL_DIFFERENCE == 0]
    start = product.two_stage(w, active)
    params, sse = product.descend(w, start, active)
    assert (sse <= product.sum_of_squares(product.residuals(w, start))).all()
    e = product.residuals(w, params)
    slope = product._jacobian(w, params, active, e)
    size = np.sqrt((slope**2).sum(axis=2) * sse[:, None]) + 1e-300
    flat = (np.abs(np.einsum("ckn,cn->ck", slope, e)) / size).max(axis=1)
    assert np.median(flat) < 1e-4 and (flat < 0.05).mean() > 0.8


@pytest.mark.parametrize(("n", "scored", "apart"), [(15, 36, 0), (20, None, None), (24, 72, 0), (80, 72, 0)])
def test_short_series_have_no_tiers(n, scored, apart):
    at = np.arange(n)
    values = 1 + np.sin(np.pi * at / 6) / 10 + at / 200 + (at * 7919 % 13) / 500
    found = product.search(values, 0 if n == 24 else 1)
    rows = {D: n - (0 if n == 24 else 1) - 12 * D for D in (0, 1)}
    for c, used in zip(found, product.ACTIVE.sum(axis=1)):
        enough = rows[c["sd"]] > used + 1
        assert ("aic" in c) == enough and (c["outcome"] == 2) == (not enough)
        assert (c["outcome"] == 3) == (enough and c["sd"] == 1 and rows[1] < product.COMMON_ROWS)
    if scored is not None:
        assert sum("aic" in c for c in found) == scored and sum(c["outcome"] == 3 for c in found) == apart
    assert product.choose(found)["outcome"] == 0


def test_flat_series_take_the_smallest_order():
    for values in (np.zeros(40), np.full(40, 1.0), np.arange(84) / 40):
        best = product.choose(product.search(values, 1))
        assert (best["p"], best["q"], best["sp"], best["sd"], best["sq"]) == (0, 0, 0, 0, 0)


def test_forecasts_equal_a_plain_recursion(spark, long_panel, tmp_path):
    frame = phase_frame(long_panel, (FUTURE,))
    path = str(tmp_path / "fits")
    product.fit(frame).write.parquet(path)
    stored = spark.read.parquet(path)
    got = {(r.state, r.step): r.yhat for r in product.predict(stored).collect()}
    assert got == {(r.state, r.step): r.yhat for r in product.forecast(frame).collect()} and len(got) == 6
    for r in stored.collect():
        values = [v.total / r.scale for v in long_panel.filter(f"state = '{r.state}'").orderBy("date").collect()]
        b = r.best
        level = np.diff(values) if r.d else np.array(values)
        w = level[12:] - level[:-12] if b.sd else level
        params = np.array([b.params])
        e, w, a, m = list(product.residuals(w, params)[0]), list(w), product.value_weights(params)[0], product.residual_weights(params)[0]
        for step in (1, 2):
            new = b.mean + sum(a[i] * (w[-k] - b.mean) + m[i] * e[-k] for i, k in enumerate(product.LAGS))
            w.append(new)
            e.append(0.0)
            y = new + (values[-1] if r.d else 0) + (values[-12] - (values[-13] if r.d else 0) if b.sd else 0)
            values.append(y)
            assert got[r.state, step] == pytest.approx(max(y * r.scale, 0), rel=1e-9)


def test_a_series_without_values_leaves_the_others_alone(spark, long_panel):
    rows = [("hole", d, None if i == 9 else float(i)) for i, d in enumerate(month_ends(2019, 1, 30))]
    rows += [("tiny", d, 1.0) for d in month_ends(2020, 1, 14)]
    mixed = long_panel.union(spark.createDataFrame(rows, long_panel.schema))
    made = product.forecast(phase_frame(mixed, (FUTURE,))).collect()
    assert {r.state: r.error for r in made} == {"grow": None, "wave": None, "line": None, "hole": "its values are not finite"}
    empty = product.order_scores(phase_frame(long_panel.limit(0), (FUTURE,)))
    assert empty.count() == 0 and empty.columns[-1] == "reason"


def test_the_product_may_fill_the_slot_of_the_competition(spark, long_panel, tmp_path):
    settings = {"seasonal_ar": {"product": True}}
    outcome = competition.compete(long_panel, ["seasonal_ar", "linear_trend"], settings=settings)
    assert {r.model for r in outcome.predictions.select("model").distinct().collect()} == {"seasonal_ar", "linear_trend"}
    assert outcome.failures.count() == 0
    assert Forecaster("seasonal_ar", product=True).get_params()["product"] == "true"
    assert Forecaster("seasonal_ar", product=True).fit(long_panel).predict(3).count() == 9
