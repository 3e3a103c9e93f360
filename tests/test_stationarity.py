import math

import numpy as np
import pytest
from months import month_ends

from seriesloom.models import seasonal_ar
from seriesloom.models.frame import FUTURE, phase_frame
from seriesloom.operators import stationarity
from seriesloom.operators.stationarity import adf_test, most_lags, p_value


def regression(x, lags, start):
    """Rows, log of the mean square and t statistic by normal equations written out."""
    rows = [[1.0, x[i], *(x[i - k + 1] - x[i - k] for k in range(1, lags + 1)), x[i + 1] - x[i]] for i in range(start, len(x) - 1)]
    a, y = np.array(rows)[:, :-1], np.array(rows)[:, -1]
    inverse = np.linalg.pinv(a.T @ a)
    b = inverse @ a.T @ y
    sse = ((y - a @ b) ** 2).sum()
    return len(y), math.log(sse / len(y)), b[1] / math.sqrt(sse / (len(y) - a.shape[1]) * inverse[1, 1])


def series():
    rng = np.random.default_rng(11)
    step = rng.normal(size=120)
    cyclic = np.zeros(120)
    for t in range(3, 120):
        cyclic[t] = 0.5 * cyclic[t - 1] - 0.6 * cyclic[t - 3] + step[t]
    return {"noise": 50 + rng.normal(size=90), "walk": 500 + np.cumsum(step), "cyclic": 20 + cyclic, "short": rng.normal(size=9)}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(name, d, float(v)) for name, x in series().items() for d, v in zip(month_ends(2010, 1, len(x)), x)]
    rows += [("flat", d, 3.0) for d in month_ends(2010, 1, 40)] + [("line", d, float(i)) for i, d in enumerate(month_ends(2010, 1, 40))]
    rows += [("two", d, float(i)) for i, d in enumerate(month_ends(2010, 1, 2))] + [("bad", d, float("inf")) for d in month_ends(2010, 1, 40)]
    rows += [("holes", d, None if i % 9 == 4 else float(i * i % 17)) for i, d in enumerate(month_ends(2010, 1, 40))]
    return spark.createDataFrame(rows, "state string, date date, total double").repartition(3)


def test_lags_and_statistic_equal_plain_regressions(panel):
    got = {r.state: r for r in adf_test(panel).collect()}
    for name, x in series().items():
        most = most_lags(len(x))
        aic = {k: (n * s + 2 * (k + 2), k) for k in range(most + 1) for n, s, _ in [regression(x, k, most)]}
        lags = min(aic.values())[1]
        n, _, t = regression(x, lags, lags)
        assert (got[name].n, got[name].lags) == (n, lags)
        np.testing.assert_allclose(got[name].t_stat, t, rtol=1e-6)
        assert got[name].p_value == pytest.approx(p_value(t), rel=1e-5)
    assert got["noise"].stationary and not got["walk"].stationary
    assert got["cyclic"].stationary and got["cyclic"].lags >= 2


def test_fixed_lags_and_limit(panel):
    x = series()["walk"]
    got = {r.state: r for r in adf_test(panel, lags=3).collect()}
    np.testing.assert_allclose(got["walk"].t_stat, regression(x, 3, 3)[2], rtol=1e-6)
    assert got["short"].reason == "9 values are too few"
    assert max(r.lags for r in adf_test(panel, limit=1).collect() if r.lags is not None) <= 1


def test_series_without_a_test_have_a_reason(panel):
    got = {r.state: r for r in adf_test(panel).collect()}
    want = {"flat": "it is constant", "two": "2 values are too few", "bad": "its values are not finite", "line": "no regression has a solution with a rest"}
    assert {name: got[name].reason for name in want} == want
    assert not any(got[name].stationary for name in want) and all(got[name].p_value is None for name in want)
    assert got["holes"].reason is None and got["holes"].n + got["holes"].lags == 36 - 1
    assert adf_test(panel.limit(0)).count() == 0


def test_p_values_of_known_quantiles():
    """1, 5 and 10 % points of the statistic with a constant in large samples."""
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert p_value(t) == pytest.approx(p, abs=0.002)
    assert p_value(-30) == 0.0 and p_value(3) == 1.0
    steps = [p_value(t) for t in np.linspace(-19, 2.8, 400)]
    assert all(a <= b + 1e-3 for a, b in zip(steps, steps[1:]))


def test_differencing_follows_the_augmented_test(panel, spark):
    long = panel.filter("state in ('noise', 'walk', 'cyclic')")
    frame = phase_frame(long, (FUTURE,))
    want = {r.state: 0 if r.stationary else 1 for r in adf_test(long).collect()}
    got = seasonal_ar.order_search(frame, augmented=True).collect()
    assert {r.state: r.d for r in got} == want and len(got) == 3
    assert seasonal_ar.forecast(frame, augmented=True).count() == 6
    assert seasonal_ar.parameters(augmented=True)["augmented"] == "true"
