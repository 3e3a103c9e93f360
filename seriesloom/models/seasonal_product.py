"""Seasonal autoregression with products of ordinary and seasonal lag polynomials, fitted by Gauss-Newton steps.

With u the differenced value less its mean and e the residual,

    (1 - phi1 B - phi2 B^2)(1 - Phi B^12) u = (1 + theta1 B + theta2 B^2)(1 + Theta B^12) e,

where B takes the value of the month before; u and e before the first row count as 0, so that every candidate order
has a residual in every row of its differenced series, however short. The sum of squared residuals is lowered from the
two-stage least-squares estimate on by damped Gauss-Newton steps, for all orders of a series together; a step that does
not lower it is not taken, so no order ends above its start.

There is no tier by length: an order is scored if it has more rows than parameters and two. AICs are those of the newest
rows, which all orders share. Where seasonal differencing leaves fewer than ``COMMON_ROWS`` rows, the orders with it keep
an AIC on their own rows and are "not comparable": they are listed, and not chosen.

Spark gathers the totals of each series (as many as the calendar has months) and deals the series over all shuffle
partitions, as the search is far more work than moving them; a task holds one Arrow batch of series and works on one
series at a time. Forecasts are array expressions over one row per series and can be made from a stored table of fits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.frame import KEYS, as_predictions, series_rows
from seriesloom.models.least_squares import OUTCOMES, explosive
from seriesloom.models.seasonal_ar import CANDIDATES, COMMON_ROWS, LEAST, NAME, ORDER, SEASON
from seriesloom.operators.stationarity import tested

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAGS = (1, 2, SEASON, SEASON + 1, SEASON + 2)
MEMORY = max(LAGS)
LONG_LAGS = (1, 2, 3, SEASON)
ROUNDS = 60
NUDGE = 1e-6
#: Parameters of an order: mean, phi1, phi2, theta1, theta2, Phi, Theta; an order uses some of them.
WIDTH = 7
ACTIVE = np.array([[True, p > 0, p > 1, q > 0, q > 1, P > 0, Q > 0] for p, q, P, _, Q in CANDIDATES])
SEASONAL_DIFFERENCE = np.array([D for _, _, _, D, _ in CANDIDATES])

TOTALS = "transform(array_sort(collect_list(if(fit, struct(at, total), null))), r -> r.total) as totals"


def value_weights(params: np.ndarray) -> np.ndarray:
    """Weights of the values at ``LAGS``, multiplied out of both polynomials."""
    one, two, season = params[:, 1], params[:, 2], params[:, 5]
    return np.stack([one, two, season, -one * season, -two * season], axis=1)


def residual_weights(params: np.ndarray) -> np.ndarray:
    """Weights of the residuals at ``LAGS``."""
    one, two, season = params[:, 3], params[:, 4], params[:, 6]
    return np.stack([one, two, season, one * season, two * season], axis=1)


def residuals(w: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Residuals (one row per row of ``params``) of the differenced series ``w``."""
    n, before = len(w), np.zeros((len(params), MEMORY))
    u = np.hstack([before, w[None, :] - params[:, :1]])
    a, m = value_weights(params), residual_weights(params)
    with np.errstate(over="ignore", invalid="ignore"):
        rest = u[:, MEMORY:] - sum(a[:, i, None] * u[:, MEMORY - lag : MEMORY - lag + n] for i, lag in enumerate(LAGS))
        e = np.hstack([before, rest])
        if m.any():
            back = MEMORY - np.array(LAGS)
            for t in range(n):
                e[:, MEMORY + t] -= (m * e[:, t + back]).sum(axis=1)
    return e[:, MEMORY:]


def sum_of_squares(e: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        total = (e * e).sum(axis=1)
    return np.where(np.isfinite(total), total, np.inf)


def _lagged(values: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    padded = np.concatenate([np.zeros(max(lags)), values])
    return np.stack([padded[max(lags) - k : max(lags) - k + len(values)] for k in lags], axis=1)


def two_stage(w: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Start of every order: least squares on own lags and on lagged residuals of a long autoregression.

    Where that is worse than the mean alone, the start is the mean alone.
    """
    u = w - w.mean()
    design = _lagged(u, LONG_LAGS)
    rest = u - design @ np.linalg.lstsq(design, u, rcond=1e-8)[0]
    values, shocks = _lagged(u, (1, 2, SEASON)), _lagged(rest, (1, 2, SEASON))
    columns = np.stack([values[:, 0], values[:, 1], shocks[:, 0], shocks[:, 1], values[:, 2], shocks[:, 2]], axis=1)
    start = np.zeros(active.shape)
    start[:, 0] = w.mean()
    plain = start.copy()
    for row, used in zip(start, active[:, 1:]):
        row[1:][used] = np.linalg.lstsq(columns[:, used], u, rcond=1e-8)[0]
    worse = ~(sum_of_squares(residuals(w, start)) <= sum_of_squares(residuals(w, plain)))
    return np.where(worse[:, None], plain, start)


def _jacobian(w: np.ndarray, params: np.ndarray, active: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Change of every residual with every parameter an order uses; 0 for the others."""
    lane, column = np.nonzero(active)
    moved = params[lane]
    moved[np.arange(len(lane)), column] += NUDGE
    out = np.zeros((*params.shape, len(w)))
    with np.errstate(over="ignore", invalid="ignore"):
        out[lane, column] = (residuals(w, moved) - e[lane]) / NUDGE
    return out


def descend(w: np.ndarray, start: np.ndarray, active: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, sums of squares) after damped Gauss-Newton steps; none is above that of its start."""
    params = start.copy()
    sse = sum_of_squares(residuals(w, params))
    damping, going = np.full(len(params), 1e-3), np.isfinite(sse)
    for _ in range(rounds):
        at = np.flatnonzero(going)
        if not len(at):
            break
        e = residuals(w, params[at])
        slope = _jacobian(w, params[at], active[at], e)
        with np.errstate(over="ignore", invalid="ignore"):
            system, right = np.einsum("ckn,cln->ckl", slope, slope), np.einsum("ckn,cn->ck", slope, e)
        usable = np.isfinite(system).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
        going[at[~usable]] = False
        at, system, right = at[usable], system[usable], right[usable]
        if not len(at):
            break
        size = np.einsum("ckk->ck", system)
        least = 1e-12 * size.max(axis=1, keepdims=True) + 1e-300
        ridge = np.where(active[at], damping[at, None] * size + least, 1.0)
        system[:, range(WIDTH), range(WIDTH)] += ridge
        # All systems are scaled to a unit diagonal, so that tiny columns do not make one singular.
        root = np.sqrt(np.einsum("ckk->ck", system))
        step = np.linalg.solve(system / (root[:, :, None] * root[:, None, :]), (right / root)[..., None])[..., 0] / root
        trial = params[at] - step
        reached = sum_of_squares(residuals(w, trial))
        better = reached < sse[at]
        gain = np.where(better, sse[at] - reached, 0.0)
        small = better & (gain <= 1e-10 * sse[at])
        params[at[better]], sse[at[better]] = trial[better], reached[better]
        damping[at] = np.where(better, damping[at] / 5, damping[at] * 6)
        going[at] = ~small & (damping[at] < 1e8)
    return params, sse


def search(values: np.ndarray, d: int, bounded: bool = False) -> list[dict]:
    """One entry per candidate order of a scaled series: AIC, sums of squares, outcome, parameters."""
    level = np.diff(values) if d else values
    rows = {0: len(level), 1: len(level) - SEASON}
    common = rows[1] if rows[1] >= COMMON_ROWS else rows[0]
    found: list[dict] = [{"rank": rank, **dict(zip(ORDER, order)), "outcome": OUTCOMES.index("too few rows")} for rank, order in enumerate(CANDIDATES)]
    for D in (0, 1):
        n = rows[D]
        at = np.flatnonzero((SEASONAL_DIFFERENCE == D) & (n > ACTIVE.sum(axis=1) + 1))
        if not len(at):
            continue
        w = level[SEASON:] - level[:-SEASON] if D else level
        start = two_stage(w, ACTIVE[at])
        before = sum_of_squares(residuals(w, start))
        params, sse = descend(w, start, ACTIVE[at])
        newest = residuals(w, params)[:, -common:]
        shared, m = sum_of_squares(newest), newest.shape[1]
        grows = explosive(value_weights(params), LAGS) | explosive(-residual_weights(params), LAGS) if bounded else np.zeros(len(at), bool)
        for i, rank in enumerate(at):
            entry = found[rank]
            entry |= {"n": n, "start_sse": float(before[i]), "sse": float(sse[i]), "params": params[i].tolist()}
            solved = np.isfinite(shared[i]) and np.isfinite(params[i]).all()
            if solved:
                entry["aic"] = float(m * np.log(max(shared[i], 1e-12) / m) + 2 * (ACTIVE[rank].sum() + 1))
            text = "no solution" if not solved else "explosive" if grows[i] else "not comparable" if n < common else ""
            entry["outcome"] = OUTCOMES.index(text)
    return found


def choose(found: list[dict]) -> dict | None:
    """Lowest AIC among comparable orders; the earlier one on a tie."""
    open_ = [c for c in found if c["outcome"] == 0]
    return min(open_, key=lambda c: (c["aic"], c["rank"])) if open_ else None


def _tails(values: np.ndarray, d: int, best: dict) -> dict:
    """What forecasts need: mean, weights and recent values, oldest first."""
    level = np.diff(values) if d else values
    w = level[SEASON:] - level[:-SEASON] if best["sd"] else level
    params = np.array([best["params"]])
    mean = params[0, 0]
    weights = {}
    for name, known in (("ar", value_weights(params)[0]), ("ma", residual_weights(params)[0])):
        full = np.zeros(MEMORY)
        full[MEMORY - np.array(LAGS)] = known
        weights[name] = full.tolist()
    recent = np.concatenate([np.full(MEMORY, mean), w])[-MEMORY:]
    errors = np.concatenate([np.zeros(MEMORY), residuals(w, params)[0]])[-MEMORY:]
    kept = ("rank", *ORDER, "aic", "params")
    return {**{k: best[k] for k in kept}, "mean": float(mean), **weights, "w": recent.tolist(), "e": errors.tolist(), "y": values[-SEASON - 1 :].tolist()}


def _one(totals: list, bounded: bool) -> tuple:
    """(d, scale, candidates, best, error) of one series."""
    x = np.array([np.nan if v is None else v for v in totals], float)
    if not np.isfinite(x).all():
        return None, None, [], None, "its values are not finite"
    scale = max(float(np.abs(x).mean()), 1e-9)
    p = tested(totals)[3]
    d = 0 if p is not None and p < 0.05 else 1
    found = search(x / scale, d, bounded)
    best = choose(found)
    if best is None:
        counts = [(sum(c["outcome"] == i for c in found), text) for i, text in enumerate(OUTCOMES) if text]
        return d, scale, found, None, "no order could be fitted: " + ", ".join(f"{k} {text}" for k, text in counts if k)
    return d, scale, found, _tails(x / scale, d, best), None


_ORDERS = [pa.field("rank", pa.int32()), *[pa.field(name, pa.int32()) for name in ORDER], pa.field("aic", pa.float64())]
_NUMBERS = pa.list_(pa.float64())
_CANDIDATE = pa.struct([*_ORDERS, ("n", pa.int32()), ("start_sse", pa.float64()), ("sse", pa.float64()), ("outcome", pa.int32()), ("params", _NUMBERS)])
_BEST = pa.struct([*_ORDERS, ("params", _NUMBERS), ("mean", pa.float64()), *[(name, _NUMBERS) for name in ("ar", "ma", "w", "e", "y")]])

_ORDER_SQL = "rank int, p int, q int, sp int, sd int, sq int, aic double"
_CANDIDATE_SQL = f"array<struct<{_ORDER_SQL}, n int, start_sse double, sse double, outcome int, params array<double>>>"
_BEST_SQL = f"struct<{_ORDER_SQL}, params array<double>, mean double, {', '.join(f'{k} array<double>' for k in ('ar', 'ma', 'w', 'e', 'y'))}>"
FITTED = f"d int, scale double, candidates {_CANDIDATE_SQL}, best {_BEST_SQL}, error string"


def candidate_fits(frame: DataFrame, bounded: bool = False) -> DataFrame:
    """One row per series and phase of at least ``LEAST`` months: all candidates, the chosen one, or the reason for none.

    ``bounded`` leaves out orders whose values or residuals grow without bound. A NULL or infinite total gives its
    series an ``error`` and leaves the others alone.
    """
    carried = [*KEYS, "n_fit", "steps", "last_date", "actuals"]
    rows = series_rows(frame, {}, F.expr(TOTALS)).filter(f"n_fit >= {LEAST}").select(*carried, "totals")
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.float64(), pa.list_(_CANDIDATE), _BEST, pa.string()]
        names = ["d", "scale", "candidates", "best", "error"]
        for batch in batches:
            made = [_one(totals, bounded) for totals in batch.column(len(carried)).to_pylist()]
            arrays = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *arrays], [*carried, *names])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carried)])
    return rows.repartition(parts, *KEYS).mapInArrow(run, f"{kept}, {FITTED}")


def fit(frame: DataFrame, bounded: bool = False) -> DataFrame:
    """One row per series and phase with the chosen order and what forecasts need, or ``error``; may be stored."""
    return candidate_fits(frame, bounded).drop("candidates")


def order_scores(frame: DataFrame, bounded: bool = False) -> DataFrame:
    """All candidates per series and phase: AIC, rows, sums of squares at the start and at the end, reason if it cannot be chosen."""
    told = " ".join(f"when outcome = {i} then '{text}'" for i, text in enumerate(OUTCOMES) if text)
    rows = candidate_fits(frame, bounded).selectExpr(*KEYS, "d", "inline(candidates)")
    return rows.selectExpr(*KEYS, "d", "rank", *ORDER, "n", "start_sse", "sse", "aic", f"case {told} end as reason")


def _path() -> str:
    """SQL text of the forecasts of one series: fold the steps over (values, residuals, totals)."""

    def weighted(values: str, weights: str, term: str) -> str:
        pairs = f"zip_with(slice({values}, -{MEMORY}, {MEMORY}), {weights}, (x, k) -> {term})"
        return f"aggregate({pairs}, 0D, (total, x) -> total + x)"

    w = f"best.mean + {weighted('acc.w', 'best.ar', 'k * (x - best.mean)')} + {weighted('acc.e', 'best.ma', 'k * x')}"
    y = f"{w} + d * element_at(acc.y, -1) + best.sd * (element_at(acc.y, -{SEASON}) - d * element_at(acc.y, -{SEASON + 1}))"
    return f"""aggregate(
        sequence(1, steps),
        struct(best.w as w, best.e as e, best.y as y),
        (acc, step) -> struct(array_append(acc.w, {w}) as w, array_append(acc.e, 0D) as e, array_append(acc.y, {y}) as y),
        acc -> transform(slice(acc.y, -steps, steps), x -> x * scale))"""


def predict(fits: DataFrame) -> DataFrame:
    """Forecasts out of a table of fits, fresh or stored."""
    error = F.col("error") if "error" in fits.columns else None
    return as_predictions(fits, NAME, F.expr(f"if(best is null, null, {_path()})"), error)


def forecast(frame: DataFrame, bounded: bool = False) -> DataFrame:
    return predict(fit(frame, bounded))


def parameters(bounded: bool = False) -> dict[str, str]:
    return {"candidates": str(len(CANDIDATES)), "season": str(SEASON), "product": "true", "bounded": str(bounded).lower()}
