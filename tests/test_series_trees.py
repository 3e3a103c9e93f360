import datetime

import numpy as np
import pytest
from months import month_ends
from pyspark.sql import functions as F

from seriesloom.models import gbt_lag, series_trees
from seriesloom.models.frame import FUTURE, PHASES, VALIDATION, phase_frame
from seriesloom.models.series_trees import Growth, grow, next_features, value_of
from seriesloom.operators.features import features_from_history, feature_names
from seriesloom.plans import competition


def shrink(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0.0)


def plain_tree(x, g, used, columns, depth, s):
    """Nested (feature, threshold, left, right) or a weight, by trying every split of every column."""
    G, H = g[used].sum(), float(used.sum())
    weight = -s.stepSize * shrink(G, s.l1) / (H + s.l2) if H + s.l2 > 0 else 0.0
    if depth == 0:
        return weight
    found = []
    score = lambda a, b: shrink(a, s.l1) ** 2 / (b + s.l2)
    for f in columns:
        for low, high in zip(np.unique(x[:, f]), np.unique(x[:, f])[1:]):
            cut = low + (high - low) / 2
            left, right = used & (x[:, f] < cut), used & (x[:, f] >= cut)
            if left.sum() < s.least_weight or right.sum() < s.least_weight:
                continue
            gain = (score(g[left].sum(), left.sum()) + score(g[right].sum(), right.sum()) - score(G, H)) / 2
            found.append((gain, f, cut, left, right))
    most = max((row[0] for row in found), default=0.0)
    if most <= series_trees.LEAST_GAIN:
        return weight
    same = most - series_trees.SAME_GAIN * (most + score(G, H))
    _, f, cut, left, right = next(row for row in found if row[0] >= same)
    return f, cut, plain_tree(x, g, left, columns, depth - 1, s), plain_tree(x, g, right, columns, depth - 1, s)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] >= tree[1] else tree[2]
    return tree


def plain_values(design, s, asked):
    x, y = design[:, :-1], design[:, -1]
    fitted, out = np.full(len(y), y.mean()), np.full(len(asked), y.mean())
    for number in range(s.max_iterations):
        draw = np.random.default_rng([s.seed, number])
        columns = np.sort(draw.permutation(x.shape[1])[: max(1, round(s.columnsRate * x.shape[1]))])
        used = draw.random(len(y)) < s.subsamplingRate
        tree = plain_tree(x, fitted - y, used, columns, s.maxDepth, s)
        fitted = fitted + [plain_value(tree, row) for row in x]
        out = out + [plain_value(tree, row) for row in asked]
    return out


def designs(sizes, seed=0):
    rng = np.random.default_rng(seed)
    made = []
    for n in sizes:
        x = np.column_stack([rng.normal(size=(n, 3)), np.arange(n) % 4])
        made.append(np.column_stack([x, 10 * x[:, 0] + np.where(x[:, 3] > 1, 5.0, 0.0) * x[:, 1] + rng.normal(size=n)]))
    return made


@pytest.mark.parametrize("settings", [{}, {"l1": 4.0, "l2": 0.0}, {"maxDepth": 2, "least_weight": 5.0, "l2": 3.0}])
def test_trees_equal_an_exhaustive_search(settings):
    s = Growth(max_iterations=12, stepSize=0.3, **settings)
    given = designs([40, 1, 25])
    made = grow(given, s)
    for i, design in enumerate(given):
        asked = designs([30], seed=7)[0][:, :-1]
        part = [np.repeat(made[name][i : i + 1], len(asked), axis=0) for name in ("base", "feature", "threshold", "leaf")]
        np.testing.assert_allclose(value_of(*part, asked), plain_values(design, s, asked), rtol=1e-9, atol=1e-9)


def test_penalties_shrink_and_many_bins_are_thinned():
    given = designs([60])
    spread = lambda **k: np.abs(grow(given, Growth(max_iterations=1, **k))["leaf"]).max()
    assert spread(l1=0.0, l2=0.0) > spread(l1=0.0, l2=20.0) > spread(l1=1e6) == 0.0
    assert len(series_trees.cuts_of(np.arange(1000.0), 16)) == 15
    few = grow(given, Growth(max_iterations=50, bins=4))
    assert len(np.unique(few["threshold"][few["feature"] == 0])) <= 4


def test_batches_do_not_change_trees(monkeypatch):
    s = Growth(max_iterations=10)
    given = designs([30, 50, 20, 41])
    together = grow(given, s)
    for i, design in enumerate(given):
        alone = grow([design], s)
        for name in together:
            np.testing.assert_array_equal(together[name][i], alone[name][0])
    monkeypatch.setattr(series_trees, "CELLS", 1)
    assert list(series_trees._chunks(given, s)) == [[0], [1], [2], [3]]


def test_next_features_equal_those_of_spark(spark):
    history = [float(v) for v in (5, 7, 0, 9, 4, 4, 8, 1, 6, 3, 2, 8, 7)]
    rows = spark.createDataFrame([(history, datetime.date(2021, 12, 31))], "history array<double>, date date")
    texts = features_from_history("history", "date", "40", known_growth_only=True)
    want = rows.select(*[F.expr(f"cast({texts[n]} as double) as {n}") for n in feature_names()]).first()
    got = next_features(np.array([history]), np.array([2021 * 12 + 11]), np.array([40]))
    np.testing.assert_allclose(got[0], list(want), rtol=1e-12, atol=1e-12)


def test_forecasts_follow_the_season_and_survive_storage(spark, long_panel, tmp_path):
    frame = phase_frame(long_panel)
    fitted = series_trees.fit(frame, PHASES, max_iterations=60)
    fitted.write.parquet(str(tmp_path / "trees"))
    of = lambda made: {(r.state, r.phase, r.step): r.yhat for r in made.collect()}
    fresh = of(gbt_lag.forecast(frame, PHASES, max_iterations=60))
    assert len(fresh) == 3 * (VALIDATION.steps + FUTURE.steps) and min(fresh.values()) >= 0
    assert of(series_trees.predict(spark.read.parquet(str(tmp_path / "trees")), gbt_lag.NAME)) == fresh
    actual = {(r.state, r.step): r.total for r in frame.filter("phase = 'val' and not fit").selectExpr("state", "at - n_fit + 1 as step", "total").collect()}
    assert np.mean([abs(fresh["wave", "val", k] / actual["wave", k] - 1) for k in range(1, 7)]) < 0.1
    shares = series_trees.importance(fitted).groupBy("state", "phase").agg(F.sum("importance").alias("s"), F.count("*").alias("n"))
    assert all(abs(r.s - 1) < 1e-9 and r.n == len(feature_names()) for r in shares.collect())


def test_short_flat_and_poisoned_series(spark, long_panel):
    """12 months are skipped, 13 give one row, a flat series repeats its value, an infinite one has its own reason."""
    rows = [("short", d, 1.0) for d in month_ends(2020, 1, 12)] + [("least", d, 3.0) for d in month_ends(2020, 1, 13)]
    rows += [("flat", d, 9.0) for d in month_ends(2020, 1, 40)] + [("bad", d, float("inf")) for d in month_ends(2020, 1, 40)]
    panel = long_panel.unionByName(spark.createDataFrame(rows, long_panel.schema))
    frame = phase_frame(panel, (FUTURE,))
    made = {(r.state, r.step): (r.yhat, r.error) for r in gbt_lag.forecast(frame, (FUTURE,), max_iterations=5).collect()}
    assert {s for s, _ in made} == {"grow", "wave", "line", "least", "flat", "bad"}
    assert made["least", 1] == (3.0, None) and made["flat", 2] == (9.0, None)
    assert made["bad", 1] == (None, "its values or design are not finite")
    assert gbt_lag.forecast(frame.limit(0), (FUTURE,), max_iterations=5).count() == 0
    outcome = competition.compete(panel, ["gbt_lag", "linear_trend"], settings={"gbt_lag": {"max_iterations": 5}})
    assert ("bad", "gbt_lag") in {(r.state, r.model) for r in outcome.failures.collect()}


def test_pooled_trees_stay_an_option(long_panel):
    frame = phase_frame(long_panel, (FUTURE,))
    made = gbt_lag.forecast(frame, (FUTURE,), pooled=True, max_iterations=3)
    assert made.count() == 6 and "error" not in made.columns
    assert gbt_lag.parameters(pooled=True)["featureSubsetStrategy"] == "0.8" and gbt_lag.parameters()["l1"] == "0.1"
