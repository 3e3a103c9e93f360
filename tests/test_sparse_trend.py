import numpy as np
import pytest
from months import month_ends

from seriesloom.functions.calendar import HOLIDAY_NAMES, holiday_calendar, holiday_days
from seriesloom.models import trend_seasonal
from seriesloom.models.frame import FUTURE, phase_frame
from seriesloom.models.least_squares import cross_products, solve_stacked, sparse_stacked

HINGES = np.arange(2, 27)
OTHERS = np.array([0, 1, *range(27, 39)])
PENALTY = np.array([0.0, 0.0] + [0.2] * 25 + [0.1] * 12)


def design(n=84):
    time = np.arange(n) / (n - 1)
    turns = 2 * np.pi * np.arange(n) / 12
    columns = [np.ones(n), time, *[np.maximum(time - 0.8 * (i + 1) / 25, 0) for i in range(25)]]
    return np.column_stack([*columns, *[f(k * turns) for k in range(1, 7) for f in (np.sin, np.cos)]])


def solved(targets, weight=1.0):
    x = design()
    counts, matrices = cross_products([np.column_stack([x, y]).ravel() for y in targets], x.shape[1] + 1)
    return x, *sparse_stacked(counts, matrices, PENALTY, HINGES, weight)


def noisy(size=0.03, change=-0.9, seed=3):
    x = design()
    return 0.7 + 0.3 * x[:, 1] + change * x[:, 2 + 9] + 0.1 * x[:, 27] + size * np.random.default_rng(seed).normal(size=len(x))


def test_optimality_conditions_hold():
    targets = [noisy(seed=s, size=size) for s, size in enumerate((0.01, 0.05, 0.2, 1.0))]
    x, found, limits = solved(targets)
    for y, b, limit in zip(targets, found, limits):
        pull = x.T @ (y - x @ b)
        np.testing.assert_allclose(pull[OTHERS], PENALTY[OTHERS] * b[OTHERS], atol=1e-6)
        on = b[HINGES] != 0
        np.testing.assert_allclose(pull[HINGES][on], limit[on] * np.sign(b[HINGES][on]), atol=1e-6)
        assert (np.abs(pull[HINGES][~on]) <= limit[~on] + 1e-6).all()


def test_most_change_points_end_at_exactly_zero():
    _, found, _ = solved([noisy(seed=s) for s in range(20)])
    _, calm, _ = solved([noisy(change=0.0, seed=s) for s in range(20)])
    taken = found[:, HINGES] != 0
    assert (taken.sum(axis=1) <= 6).all() and taken[:, 8:11].any(axis=1).all()
    assert ((calm[:, HINGES] != 0).sum(axis=1) == 0).mean() >= 0.7
    none, all_of_them = solved([noisy()], weight=1e6)[1][0], solved([noisy()], weight=0.0)[1][0]
    assert (none[HINGES] == 0).all() and (all_of_them[HINGES] != 0).sum() > 15


def test_flat_and_broken_series():
    _, found, _ = solved([np.full(84, 0.7), np.zeros(84), np.full(84, np.nan), noisy()])
    assert (found[:2, HINGES] == 0).all() and np.isnan(found[2]).all() and np.isfinite(found[3]).all()
    np.testing.assert_allclose(found[0][:2], [0.7, 0.0], atol=1e-4)
    alone = solved([noisy()])[1][0]
    np.testing.assert_allclose(found[3], alone, atol=1e-9)
    counts, matrices = cross_products([np.column_stack([design(), noisy()]).ravel()], 40)
    assert np.isfinite(solve_stacked(matrices, np.arange(39), PENALTY)[0]).all() and counts[0] == 84


@pytest.fixture(scope="module")
def turning(spark):
    """A trend that turns after 60 of 120 months, and a straight one."""
    dates, at = month_ends(2010, 1, 120), np.arange(120)
    noise = np.random.default_rng(7).normal(size=(2, 120)) * 0.01
    series = {"turn": np.expm1(0.6 + 0.004 * at - 0.012 * np.maximum(at - 60, 0) + noise[0]), "straight": np.expm1(0.5 + 0.003 * at + noise[1])}
    rows = [(s, d, 1000 * float(v)) for s, values in series.items() for d, v in zip(dates, values)]
    return phase_frame(spark.createDataFrame(rows, "state string, date date, total double"), (FUTURE,)).cache()


def test_changes_are_listed_with_their_month(turning):
    rows = trend_seasonal.trend_changes(turning).collect()
    assert {r.state for r in rows} == {"turn"}
    largest = min(rows, key=lambda r: r.slope_change)
    assert largest.slope_change < -0.004 and abs((largest.date.year - 2015) * 12 + largest.date.month - 1) <= 4
    assert sum(r.slope_change for r in rows) == pytest.approx(-0.012, rel=0.15)
    ridge = trend_seasonal.trend_changes(turning, sparse=False)
    assert ridge.count() == 50


def test_sparse_and_named_settings_forecast(turning):
    made = trend_seasonal.forecast(turning, sparse=True, named_holidays=True).collect()
    assert len(made) == 4 and all(r.error is None and r.yhat > 0 for r in made)
    want = 1000 * np.expm1(0.5 + 0.003 * 120)
    assert next(r.yhat for r in made if r.state == "straight" and r.step == 1) == pytest.approx(want, rel=0.03)
    effects = trend_seasonal.holiday_effects(turning).collect()
    assert len(effects) == 2 * len(HOLIDAY_NAMES) and {r.holiday for r in effects} == set(HOLIDAY_NAMES)
    assert all(np.isfinite(r.effect) for r in effects)
    assert trend_seasonal.holiday_effects(turning, named_holidays=False).count() == 2
    assert trend_seasonal.parameters(sparse=True)["sparse"] == "true"


def test_holiday_days_equal_the_calendar(spark):
    years = spark.range(1980, 2035).selectExpr("cast(id as int) as year")
    counted = holiday_calendar(years).selectExpr("last_day(date) as date", "replace(name, ' (observed)', '') as name")
    want = {(r.date, r.name): r["count"] for r in counted.groupBy("date", "name").count().collect()}
    months = years.selectExpr("explode(transform(sequence(1, 12), m -> last_day(make_date(year, m, 1)))) as date")
    got = {}
    for r in months.select("date", *[c.alias(f"h{i}") for i, c in enumerate(holiday_days("date").values())]).collect():
        got |= {(r.date, name): r[f"h{i}"] for i, name in enumerate(HOLIDAY_NAMES) if r[f"h{i}"]}
    assert got == want
