"""Least squares for many series at once.

Spark computes the design columns and gathers the rows of each series, which are as many as
the calendar has months. Arrow hands batches of series to numpy, which forms the small cross
product matrix of each and solves them stacked.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

JITTER = 1e-9
#: What became of a candidate, by number.
OUTCOMES = ("", "explosive", "too few rows", "not comparable", "no solution")

# Executors get these helpers inside the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def design_rows(design: list[str], target: str, use: str, name: str) -> Column:
    """Aggregate: the rows [design, target] where ``use`` holds, as one flat array.

    ``design`` and ``target`` are SQL terms. The order of rows does not matter.
    """
    row = f"array({', '.join([*design, target])})"
    return F.expr(f"flatten(collect_list(if({use}, {row}, null))) as {name}")


def cross_products(batch: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row counts, stacked matrices [design, target]' [design, target]) of flat arrays."""
    counts, matrices = np.zeros(len(batch)), np.zeros((len(batch), width, width))
    for i, flat in enumerate(batch):
        rows = np.asarray(flat, dtype=float).reshape(-1, width)
        counts[i], matrices[i] = len(rows), rows.T @ rows
    return counts, matrices


def _solved(systems: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems; a system without one gives NaN and leaves the others alone."""
    out = np.full(right.shape, np.nan)
    good = np.isfinite(systems).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
    for i in np.flatnonzero(good):
        try:
            out[i] = np.linalg.solve(systems[i], right[i])
        except np.linalg.LinAlgError:
            continue
    return out


def solve_stacked(matrices: np.ndarray, keep: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the kept columns and residual sums of squares, per matrix.

    The last row and column of each matrix belong to the target. A small multiple of the
    largest diagonal entry keeps collinear designs solvable.
    """
    k = len(keep)
    gram = matrices[np.ix_(range(len(matrices)), keep, keep)]
    moment = matrices[:, keep, -1]
    largest = np.einsum("nii->ni", gram).max(axis=1)
    largest = np.where(largest > 0, largest, 1.0)
    ridge = np.zeros((len(matrices), k, k))
    ridge[:, range(k), range(k)] = penalty[None, :] + JITTER * largest[:, None]
    coefficients = _solved(gram + ridge, moment)
    explained = 2 * np.einsum("nk,nk->n", coefficients, moment)
    fitted = np.einsum("nk,nkl,nl->n", coefficients, gram, coefficients)
    return coefficients, np.maximum(matrices[:, -1, -1] - explained + fitted, 0.0)


def least_squares(rows: np.ndarray, keep: np.ndarray, target: int) -> tuple[np.ndarray, float]:
    """Coefficients of the kept columns of one design and the residual sum of squares; NaN without a solution."""
    wide = rows[:, [*keep, target]]
    b, sse = solve_stacked((wide.T @ wide)[None], np.arange(len(keep)), np.zeros(len(keep)))
    return b[0], float(sse[0])


def explosive(coefficients: np.ndarray, lags: tuple[int, ...], periods: int = 5, limit: float = 1.05) -> np.ndarray:
    """Whether the effect of one shock keeps growing from the first period after it to the last.

    A period is as long as the longest lag; ``coefficients`` holds the weights of the lagged
    values in its last axis. A lasting wave or level is not growth.
    """
    memory = max(lags)
    effect = np.zeros((*coefficients.shape[:-1], memory * (periods + 1)))
    effect[..., memory - 1] = 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(memory, effect.shape[-1]):
            effect[..., t] = sum(coefficients[..., i] * effect[..., t - lag] for i, lag in enumerate(lags))
        early = np.abs(effect[..., memory : 2 * memory]).max(axis=-1)
        late = np.abs(effect[..., -memory:]).max(axis=-1)
        return ~(late <= limit * np.maximum(early, 1.0))


def score_candidates(flat, start: int, kept: list[list[int]], lags: tuple[int, ...], width: int, bounded: bool) -> list[list[float]]:
    """Per candidate (its kept columns) of one series: AIC, whether it is explosive, all coefficients.

    ``flat`` holds rows of design, target and place. AICs are those of the rows from ``start`` on, which all
    candidates must be able to use; coefficients those of every row a candidate can use. A candidate without AIC
    has one of ``OUTCOMES`` in the place that says whether it is explosive.
    """
    rows = np.asarray(flat, dtype=float).reshape(-1, width + 2)
    known, place = np.isfinite(rows[:, width]), rows[:, width + 1]
    result = np.full((len(kept), 2 + width), np.nan)
    for i, columns in enumerate(kept):
        keep = np.asarray(columns)
        own = known & np.isfinite(rows[:, keep]).all(axis=1)
        common = own & (place >= start)
        n = int(common.sum())
        if n <= len(keep) + 1 or n < int((place >= start).sum()):
            result[i, 1] = OUTCOMES.index("too few rows" if n <= len(keep) + 1 else "not comparable")
            continue
        _, sse = least_squares(rows[common], keep, width)
        b, _ = least_squares(rows[own], keep, width)
        if not np.isfinite(b).all() or not np.isfinite(sse):
            result[i, 1] = OUTCOMES.index("no solution")
            continue
        result[i, 2:] = 0.0
        result[i, 2 + keep] = b
        values, residuals = result[i, 3 : 3 + len(lags)], result[i, 3 + len(lags) :]
        unbounded = bounded and bool(explosive(values, lags) | explosive(-residuals, lags))
        result[i, 1] = float(unbounded)
        if not unbounded:
            result[i, 0] = n * np.log(max(sse, 1e-12) / n) + 2 * (len(keep) + 1)
    return result.tolist()


def sparse_stacked(
    counts: np.ndarray, matrices: np.ndarray, penalty: np.ndarray, sparse: np.ndarray, weight: float, sweeps: int = 5000, tolerance: float = 1e-10
) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, absolute penalties of the ``sparse`` columns) per matrix; NaN without a solution.

    Minimises half the squared rest, plus half of ``penalty`` times the squares of the other columns, plus the absolute
    penalty of each sparse one: ``weight`` times the noise times its norm once the other columns are taken out of it times
    sqrt(2 ln k). At weight 1 a column of pure noise is rarely taken up. The noise is that of the ridge fit with all
    ``penalty``, and at least a millionth of the size of the target. The other columns are eliminated, so coordinate descent runs over the sparse ones alone.
    """
    k = matrices.shape[1] - 1
    others = np.setdiff1d(np.arange(k), sparse)
    _, sse = solve_stacked(matrices, np.arange(k), penalty)
    rows = np.maximum(counts, 1.0)
    noise = np.maximum(np.sqrt(sse / rows), 1e-6 * np.sqrt(np.maximum(matrices[:, -1, -1], 0.0) / rows))
    out = np.full((len(matrices), k), np.nan)
    slope = np.full((len(matrices), len(others), 1 + len(sparse)), np.nan)
    for i in np.flatnonzero(np.isfinite(matrices).all(axis=(1, 2)) & np.isfinite(noise)):
        gram = matrices[i][np.ix_(others, others)]
        system = gram + np.diag(penalty[others] + JITTER * max(gram.diagonal().max(), 1e-300))
        try:
            slope[i] = np.linalg.solve(system, matrices[i][np.ix_(others, [k, *sparse])])
        except np.linalg.LinAlgError:
            continue
    good = np.flatnonzero(np.isfinite(slope).all(axis=(1, 2)))
    mixed = matrices[good][:, others][:, :, sparse]
    own = matrices[good][:, sparse][:, :, sparse]
    reduced = own - np.einsum("nds,ndt->nst", mixed, slope[good][:, :, 1:])
    right = matrices[good][:, sparse, -1] - np.einsum("nds,nd->ns", mixed, slope[good][:, :, 0])
    left = np.einsum("nss->ns", reduced)
    usable = left > 1e-10 * np.maximum(np.einsum("nss->ns", own), 1e-300)
    left = np.where(usable, left, 1.0)
    limits = np.full((len(matrices), len(sparse)), np.nan)
    limits[good] = weight * noise[good, None] * np.sqrt(left) * np.sqrt(2 * np.log(max(len(sparse), 2)))
    bound = np.where(usable, limits[good], np.inf)
    small = tolerance * np.sqrt(np.maximum(matrices[good, -1, -1], 1e-300))
    b = np.zeros((len(good), len(sparse)))
    going = np.arange(len(good))
    g, r, x = reduced, right, b.copy()
    for _ in range(sweeps):
        moved = np.zeros(len(going))
        for j in range(len(sparse)):
            d = left[going, j]
            rho = r[:, j] - np.einsum("ns,ns->n", g[:, j], x) + reduced[going, j, j] * x[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - bound[going, j], 0.0) / d
            moved = np.maximum(moved, np.abs(new - x[:, j]) * np.sqrt(d))
            x[:, j] = new
        b[going] = x
        on = moved > small[going]
        if not on.any():
            break
        if not on.all():
            going = going[on]
            g, r, x = reduced[going], right[going], b[going]
    out[good[:, None], sparse] = b
    out[good[:, None], others] = slope[good][:, :, 0] - np.einsum("nds,ns->nd", slope[good][:, :, 1:], b)
    return out, limits


def penalised_solutions(rows: Column, penalty: list[float], sparse: list[int] | None = None, weight: float = 1.0) -> Column:
    """Struct per flat array of rows: the coefficients ``coef``, or the reason ``error`` why there are none.

    The columns ``sparse``, if any, get an absolute penalty instead of their squared one (``sparse_stacked``).
    """
    weights = np.asarray(penalty, dtype=float)
    least = int((weights == 0).sum()) + 1

    def reason(n: float, matrix: np.ndarray, c: np.ndarray) -> str | None:
        if n < least:
            return f"{int(n)} rows, {least} needed"
        if not np.isfinite(matrix).all():
            return "its values or design are not finite"
        return None if np.isfinite(c).all() else "its system of equations has no solution"

    @F.pandas_udf("coef array<double>, error string")
    def solve(batch: pd.Series) -> pd.DataFrame:
        counts, matrices = cross_products(batch, len(weights) + 1)
        if sparse:
            coefficients, _ = sparse_stacked(counts, matrices, weights, np.asarray(sparse), weight)
        else:
            coefficients, _ = solve_stacked(matrices, np.arange(len(weights)), weights)
        errors = [reason(n, m, c) for n, m, c in zip(counts, matrices, coefficients)]
        return pd.DataFrame({"coef": [c if e is None else None for c, e in zip(coefficients, errors)], "error": errors})

    return once(solve)(rows)


def ridge_coefficients(rows: Column, penalty: list[float]) -> Column:
    """Coefficient array per flat array of rows; NULL with too few rows for the unpenalised columns or without a solution."""
    return penalised_solutions(rows, penalty)["coef"]


def once(udf):
    """Keep the optimizer from evaluating the function again in a filter pushed below it."""
    return udf.asNondeterministic()


def dot(coefficients: str, values: list[str]) -> str:
    """SQL text of the linear combination with an array of coefficients."""
    return "(" + " + ".join(f"get({coefficients}, {i}) * {value}" for i, value in enumerate(values)) + ")"
