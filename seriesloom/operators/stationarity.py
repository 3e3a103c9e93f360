"""Augmented Dickey-Fuller test with a constant, for every series at once.

Spark gathers the values of each series in time order, as many as the calendar has months, and numpy solves its few
small regressions in Arrow batches. The number of lagged differences is chosen by AIC on rows that all candidates
share; the chosen test then uses every row its lags allow.

A series whose test cannot be computed (too few months, constant, values that are not finite, no rest to measure the
error by) counts as not stationary; ``reason`` says why. Missing values are left out.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.least_squares import once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# P-value of the statistic with a constant (MacKinnon 1994), polynomials under the normal distribution.
LOWEST, TURN, HIGHEST = -18.83, -1.61, 2.74
LOW = (2.1659, 1.4412, 0.038269)
HIGH = (1.7339, 0.93202, -0.12745, -0.010368)

RESULT = "n long, lags int, t_stat double, p_value double, reason string"


def p_value(t: float) -> float:
    if t <= LOWEST or t > HIGHEST:
        return float(t > HIGHEST)
    z = sum(c * t**i for i, c in enumerate(LOW if t <= TURN else HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def most_lags(n: int) -> int:
    """Largest number of lagged differences tried for n values; negative if there are too few for any test."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def _regression(values: np.ndarray, lags: int, start: int) -> tuple[int, float, float] | None:
    """(rows, sum of squares, t statistic) of the change on a constant, the level and lagged changes, from row ``start`` on."""
    change = np.diff(values)
    columns = [np.ones(len(change) - start), values[start:-1] - values.mean()]
    columns += [change[start - k : len(change) - k] for k in range(1, lags + 1)]
    x, y = np.column_stack(columns), change[start:]
    if len(y) <= x.shape[1]:
        return None
    x = x / np.maximum(np.abs(x).max(axis=0), 1e-300)
    b, _, rank, _ = np.linalg.lstsq(x, y, rcond=1e-10)
    rest = y - x @ b
    sse = float(rest @ rest)
    if rank < x.shape[1] or sse <= 1e-20 * float(y @ y):
        return None
    error = sse / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]
    return len(y), sse, float(b[1] / math.sqrt(error))


def tested(values: list[float], lags: int | None = None, limit: int | None = None) -> tuple:
    """(rows, lags, t statistic, p-value, reason) of one series; the reason is there when the test is not."""
    x = np.asarray(values, float)
    most = most_lags(len(x)) if limit is None else min(limit, len(x) // 2 - 2)
    if most < 0 or (lags is not None and lags > len(x) // 2 - 2):
        return None, None, None, None, f"{len(x)} values are too few"
    if not np.isfinite(x).all():
        return None, None, None, None, "its values are not finite"
    if np.ptp(x) == 0:
        return None, None, None, None, "it is constant"
    if lags is None:
        fits = {k: _regression(x, k, most) for k in range(most + 1)}
        scores = {k: fit[0] * math.log(fit[1] / fit[0]) + 2 * (k + 2) for k, fit in fits.items() if fit}
        if not scores:
            return None, None, None, None, "no regression has a solution with a rest"
        lags = min(scores, key=lambda k: (scores[k], k))
    fit = _regression(x, lags, lags)
    if fit is None:
        return None, lags, None, None, "its regression has no solution with a rest"
    return fit[0], lags, fit[2], p_value(fit[2]), None


def adf_test(panel: DataFrame, lags: int | None = None, limit: int | None = None, alpha: float = 0.05, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Test per group of ``keys``: with ``lags`` lagged differences, or with the number up to ``limit`` that AIC chooses."""

    @F.pandas_udf(RESULT)
    def test(batch: pd.Series) -> pd.DataFrame:
        rows = [tested(values, lags, limit) for values in batch]
        names = ["n", "lags", "t_stat", "p_value", "reason"]
        kinds = {"n": "Int64", "lags": "Int32", "t_stat": "float64", "p_value": "float64"}
        return pd.DataFrame(rows, columns=names).astype(kinds)

    ordered = "transform(array_sort(collect_list(if(total is null, null, struct(date, total)))), r -> r.total)"
    series = panel.groupBy(*keys).agg(F.expr(f"{ordered} as _values"))
    made = series.select(*keys, once(test)("_values").alias("_test")).select(*keys, "_test.*")
    return made.withColumn("stationary", F.expr(f"coalesce(p_value < {alpha}, false)"))
