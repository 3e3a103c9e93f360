"""Seasonal autoregression with moving-average terms and an order search by AIC.

A two-stage (Hannan-Rissanen) least-squares estimate: a long autoregression gives residuals,
then the value is regressed on its own lags and on lagged residuals. Seasonal lags enter
additively. Every candidate order is a subset of the columns of one design, so one small cross
product matrix per series serves all candidates; the panel is never repeated per candidate.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.models.frame import FIT_ORDER, KEYS, OF_FIT, as_predictions, series_rows, skipped
from seriesloom.models.least_squares import OUTCOMES, design_rows, dot, once, ridge_coefficients, score_candidates
from seriesloom.operators.analysis import CRITICAL, dickey_fuller_statistic
from seriesloom.operators.stationarity import adf_test

NAME = "seasonal_ar"
SEASON = 12
LEAST = 15

# The searched orders (p, q, P, D, Q).
P_RANGE = [0, 1, 2]
Q_RANGE = [0, 1, 2]
SEASONAL_P_RANGE = [0, 1]
SEASONAL_D_RANGE = [0, 1]
SEASONAL_Q_RANGE = [0, 1]

CANDIDATES = list(product(P_RANGE, Q_RANGE, SEASONAL_P_RANGE, SEASONAL_D_RANGE, SEASONAL_Q_RANGE))


@dataclass(frozen=True)
class Variant:
    """A differenced series and the lags used on it; short series use the variants with few lags."""

    name: str
    seasonal_difference: int
    lags: tuple[int, ...]
    long_lags: tuple[int, ...]

    @property
    def lost(self) -> int:
        return SEASON * self.seasonal_difference

    def columns_of(self, p: int, q: int, P: int, Q: int) -> list[int] | None:
        """Design columns of an order: intercept, value lags, residual lags."""
        if (P or Q) and SEASON not in self.lags:
            return None
        value = [k for k in self.lags if k <= p or (k == SEASON and P)]
        residual = [k for k in self.lags if k <= q or (k == SEASON and Q)]
        at = {k: i for i, k in enumerate(self.lags)}
        return [0, *[1 + at[k] for k in value], *[1 + len(self.lags) + at[k] for k in residual]]

    @property
    def orders(self) -> list[tuple[int, tuple[int, ...], list[int]]]:
        """(rank in the candidate list, order, design columns)."""
        found = []
        for rank, (p, q, P, D, Q) in enumerate(CANDIDATES):
            columns = self.columns_of(p, q, P, Q)
            if D == self.seasonal_difference and columns is not None:
                found.append((rank, (p, q, P, D, Q), columns))
        return found


PLAIN = Variant("plain", 0, (1, 2), (1, 2, 3))
LEVEL = Variant("level", 0, (1, 2, SEASON), (1, 2, 3, SEASON))
SEASONAL = Variant("seasonal", 1, (1, 2, SEASON), (1, 2, 3, SEASON))
SHORT = Variant("short", 1, (1, 2), (1, 2, 3))
VARIANTS = [PLAIN, LEVEL, SEASONAL, SHORT]

#: Rows that all scored candidates of a series share, by what they need before them, and the variants
#: that this admits. A series takes the first for which ``COMMON_ROWS`` rows are left.
COMMON_ROWS = 9
COMMON = [(2 * SEASON, (LEVEL, SEASONAL)), (SEASON + 2, (LEVEL, SHORT)), (2, (PLAIN,))]


def _orders_sql(orders: list[tuple[int, tuple[int, ...]]]) -> str:
    """SQL text of an array of (rank, p, q, sp, sd, sq)."""
    names = ("p", "q", "sp", "sd", "sq")
    return "array({})".format(
        ", ".join(
            f"struct({rank} as rank, " + ", ".join(f"{v} as {name}" for name, v in zip(names, order)) + ")"
            for rank, order in orders
        )
    )


def order_candidates(tested: DataFrame) -> DataFrame:
    """All candidate orders per series; ``tested`` holds (state, stationary)."""
    orders = _orders_sql(list(enumerate(CANDIDATES)))
    return tested.selectExpr("state", "if(stationary, 0, 1) as d", f"inline({orders})")


def _differenced(frame: DataFrame, augmented: bool = False) -> DataFrame:
    """Series relative to their mean, with the order ``d`` of the stationarity test, and differences."""
    decided = f"_t < {CRITICAL.format('_n')}"
    if augmented:
        tests = adf_test(frame.filter("fit"), keys=tuple(KEYS)).select(*KEYS, F.col("stationary").alias("_stationary"))
        frame, decided = frame.join(tests, KEYS, "left"), "_stationary"
    rows = frame.withColumn("_level", F.expr(f"if(fit, lag(total) over ({FIT_ORDER}), null)"))
    statistic, n = dickey_fuller_statistic("if(fit, total - _level, null)", "_level", OF_FIT)
    rows = rows.selectExpr(
        "*",
        f"{statistic} as _t",
        f"{n} as _n",
        f"greatest(avg(if(fit, abs(total), null)) over ({OF_FIT}), 1e-9D) as scale",
    )
    rows = rows.selectExpr("*", f"if(coalesce({decided}, false), 0, 1) as d", "total / scale as v")
    level = f"if(d = 1, v - lag(v) over ({FIT_ORDER}), v)"
    rows = rows.selectExpr("*", f"{level} as w_level", f"{level} as w_plain")
    rows = rows.withColumn("w_seasonal", F.expr(f"w_level - lag(w_level, {SEASON}) over ({FIT_ORDER})"))
    rows = rows.withColumn("w_short", F.col("w_seasonal"))
    lags = [
        f"lag(w_{v.name}, {k}) over ({FIT_ORDER}) as w_{v.name}_{k}"
        for v in VARIANTS
        for k in sorted({*v.lags, *v.long_lags})
    ]
    return rows.selectExpr("*", *lags).drop("_level", "_t", "_n", "v", "_stationary")


def _long_design(v: Variant) -> list[str]:
    return ["1D", *[f"w_{v.name}_{k}" for k in v.long_lags]]


def _has_long(v: Variant) -> str:
    return f"(fit and at >= d + {v.lost + max(v.long_lags)})"


def _with_residuals(rows: DataFrame) -> DataFrame:
    """Residuals of the long autoregressions; 0 before their first row.

    The rows of a series travel with its coefficients as an array, as long as the calendar,
    so they need not be computed twice and joined.
    """
    designs = [
        design_rows(_long_design(v), f"w_{v.name}", _has_long(v), f"long_{v.name}") for v in VARIANTS
    ]
    carried = [name for name in rows.columns if name not in KEYS]
    fits = rows.groupBy(*KEYS).agg(*designs, F.collect_list(F.struct(*carried)).alias("rows"))
    solved = {
        f"b_{v.name}": ridge_coefficients(F.col(f"long_{v.name}"), [0.0] * (1 + len(v.long_lags))) for v in VARIANTS
    }
    coefficients = [f"b_{v.name}" for v in VARIANTS]
    joined = fits.withColumns(solved).selectExpr(*KEYS, *coefficients, "inline(rows)")
    residuals = [
        f"coalesce(if({_has_long(v)}, w_{v.name} - {dot(f'b_{v.name}', _long_design(v))}, null), 0D) as e_{v.name}"
        for v in VARIANTS
    ]
    joined = joined.selectExpr("*", *residuals).drop(*coefficients)
    lags = [
        f"coalesce(lag(e_{v.name}, {k}) over ({FIT_ORDER}), 0D) as e_{v.name}_{k}" for v in VARIANTS for k in v.lags
    ]
    return joined.selectExpr("*", *lags)


def _design(v: Variant) -> list[str]:
    return ["1D", *[f"w_{v.name}_{k}" for k in v.lags], *[f"e_{v.name}_{k}" for k in v.lags]]


def _start() -> str:
    """SQL text of the first row that the scored candidates of a series share."""
    *longer, (last, _) = COMMON
    cases = " ".join(f"when n_fit - d - {need} >= {COMMON_ROWS} then {need}" for need, _ in longer)
    return f"(d + case {cases} else {last} end)"


def _score(v: Variant, designs: Column, start: Column, bounded: bool) -> Column:
    """Per candidate order of the variant: AIC on the common rows, whether it was left out as explosive, then the
    full coefficient vector.

    The coefficients are those of a fit on every row that the lags of the order allow, whatever the common rows.
    With ``bounded``, a candidate whose dynamics, or whose residuals worked out from them, grow without
    bound gets no AIC and so cannot be chosen.
    """
    kept, lags = [columns for _, _, columns in v.orders], v.lags
    width = 1 + 2 * len(lags)

    @F.pandas_udf("array<array<double>>")
    def solve(batch: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([score_candidates(flat, start, kept, lags, width, bounded) for flat, start in zip(batch, starts)])

    return once(solve)(designs, start)


def _scored(v: Variant) -> str:
    """SQL text of the candidate structs of a variant: (aic, order, variant, coefficients, outcome)."""
    known = _orders_sql([(rank, order) for rank, order, _ in v.orders])
    return f"""zip_with(scores_{v.name}, {known}, (s, o) -> struct(
        nanvl(get(s, 0), null) as aic, o as `order`, '{v.name}' as variant, slice(s, 3, {2 * len(v.lags) + 1}) as coef,
        cast(nanvl(get(s, 1), 0D) as int) as outcome))"""


def candidate_scores(frame: DataFrame, bounded: bool = False, augmented: bool = False) -> DataFrame:
    """One row per series and phase with every scored candidate and the recent values to forecast from.

    Candidates of a series are compared on the rows that all of them can use; those that need more rows
    than the series has are not among them (``order_scores`` lists them with the reason).
    """
    rows = _with_residuals(_differenced(frame, augmented))
    memory = {"total": SEASON + 2}
    for v in VARIANTS:
        memory[f"w_{v.name}"] = SEASON
        memory[f"e_{v.name}"] = SEASON
    designs = [design_rows([*_design(v), f"w_{v.name}"], "cast(at as double)", "fit", f"designs_{v.name}") for v in VARIANTS]
    made = series_rows(rows, memory, *designs, F.expr("max(d) as d"), F.expr("max(scale) as scale"))
    made = made.filter(f"n_fit >= {LEAST}").withColumn("start", F.expr(_start()))
    made = made.withColumns(
        {f"scores_{v.name}": _score(v, F.col(f"designs_{v.name}"), F.col("start"), bounded) for v in VARIANTS}
    )
    joined = [(need, f"concat({', '.join(map(_scored, variants))})") for need, variants in COMMON]
    cases = " ".join(f"when start = d + {need} then {text}" for need, text in joined)
    dropped = [f"{kind}_{v.name}" for v in VARIANTS for kind in ("designs", "scores")]
    return made.withColumn("candidates", F.expr(f"case {cases} end")).drop(*dropped, "start")


def fit(frame: DataFrame, bounded: bool = False, keep_failed: bool = False, augmented: bool = False) -> DataFrame:
    """The lowest AIC per series and phase; a candidate that cannot be fitted takes no part.

    ``augmented`` takes the order of differencing from the augmented test instead of the plain one.

    With ``keep_failed``, series without any candidate stay, with the reason as ``error``.
    """
    best = F.expr("array_min(filter(candidates, c -> c.aic is not null))")
    scored = candidate_scores(frame, bounded, augmented).withColumn("best", best)
    counted = ", ".join(
        f"nullif(concat(size(filter(candidates, c -> c.outcome = {i})), ' {text}'), '0 {text}')" for i, text in enumerate(OUTCOMES) if text
    )
    error = F.expr(f"if(best is null, concat('no order could be fitted: ', concat_ws(', ', {counted})), null) as error")
    scored = scored.select("*", error).drop("candidates")
    return scored if keep_failed else scored.filter("best is not null").drop("error")


ORDER = ("p", "q", "sp", "sd", "sq")


def order_search(frame: DataFrame, bounded: bool = False, augmented: bool = False) -> DataFrame:
    order = [f"best.`order`.{name} as {name}" for name in ORDER]
    return fit(frame, bounded, augmented=augmented).selectExpr(*KEYS, "d", *order, f"{SEASON} as season", "best.aic as aic")


def order_scores(frame: DataFrame, bounded: bool = False) -> DataFrame:
    """All candidates per series and phase with their AIC, or the reason why there is none."""
    known = f"inline({_orders_sql(list(enumerate(CANDIDATES)))})"
    rows = candidate_scores(frame, bounded).selectExpr(*KEYS, "d", "candidates", known)
    found = "get(filter(candidates, c -> c.`order`.rank = rank), 0)"
    rows = rows.withColumn("c", F.expr(found))
    told = " ".join(f"when c.outcome = {i} then '{text}'" for i, text in enumerate(OUTCOMES) if text)
    reason = f"case {told} when c.aic is null then 'too few rows' end as reason"
    return rows.selectExpr(*KEYS, "d", "rank", *ORDER, "c.aic as aic", reason)


def series_parameters(frame: DataFrame, bounded: bool = False) -> DataFrame:
    """``(state, phase, model, params)``: the chosen orders and their AIC."""
    texts = {"order": "p, d, q", "seasonal_order": f"sp, sd, sq, {SEASON}"}
    pairs = [f"'{name}', concat('(', concat_ws(', ', {values}), ')')" for name, values in texts.items()]
    return order_search(frame, bounded).selectExpr(
        *KEYS, f"'{NAME}' as model", f"map({', '.join(pairs)}, 'aic', cast(aic as string)) as params"
    )


def _path(v: Variant) -> str:
    """SQL text of the forecasts of one variant: fold the steps over (values, residuals, totals)."""

    def back(values: str, k: int) -> str:
        return f"coalesce(try_element_at({values}, -{k}), 0D)"

    w = dot("best.coef", ["1D", *[back("acc.w", k) for k in v.lags], *[back("acc.e", k) for k in v.lags]])
    y = f"{w} + d * {back('acc.y', 1)}"
    if v.seasonal_difference:
        y += f" + {back('acc.y', SEASON)} - d * {back('acc.y', SEASON + 1)}"
    return f"""aggregate(
        sequence(1, steps),
        struct(w_{v.name}_tail as w, e_{v.name}_tail as e, transform(total_tail, x -> x / scale) as y),
        (acc, s) -> struct(array_append(acc.w, {w}) as w, array_append(acc.e, 0D) as e, array_append(acc.y, {y}) as y),
        acc -> transform(slice(acc.y, -steps, steps), x -> x * scale))"""


def forecast(frame: DataFrame, **settings) -> DataFrame:
    """``settings``: ``bounded`` leaves out explosive candidates, ``augmented`` differences by the augmented test."""
    return predict(fit(frame, keep_failed=True, **settings))


def predict(fits: DataFrame) -> DataFrame:
    """Forecasts out of a table of fits, fresh or stored."""
    cases = " ".join(f"when '{v.name}' then {_path(v)}" for v in VARIANTS)
    error = F.col("error") if "error" in fits.columns else None
    return as_predictions(fits, NAME, F.expr(f"case best.variant {cases} end"), error)


def fitted_values(frame: DataFrame, **settings) -> DataFrame:
    """In-sample values of the chosen order for all rows that its lags allow."""
    best = fit(frame, **settings).select(*KEYS, "best")
    cases = []
    for v in VARIANTS:
        known = [f"coalesce({x}, 0D)" for x in _design(v)]
        first = f"d + {v.lost} + greatest(best.`order`.p, {SEASON} * best.`order`.sp)"
        value = f"total - (w_{v.name} - {dot('best.coef', known)}) * scale"
        cases.append(f"when best.variant = '{v.name}' and fit and at >= {first} then {value}")
    rows = _with_residuals(_differenced(frame, settings.get("augmented", False))).join(best, KEYS)
    inside = rows.withColumn("fitted", F.expr(f"case {' '.join(cases)} end")).filter("fitted is not null")
    return inside.selectExpr("state", f"'{NAME}' as model", "phase", "date", "total", "fitted")


def skipped_series(frame: DataFrame) -> DataFrame:
    return skipped(frame, NAME, LEAST, "an order search")


def parameters(bounded: bool = False, augmented: bool = False) -> dict[str, str]:
    flags = {"bounded": str(bounded).lower(), "augmented": str(augmented).lower()}
    return {"candidates": str(len(CANDIDATES)), "season": str(SEASON), **flags}
