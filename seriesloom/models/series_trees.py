"""Boosted trees of one series each, with gradient and curvature sums and L1 and L2 penalties on leaves.

Spark builds the features of a series with windows and gathers its rows, as many as the calendar has months. Arrow
hands batches of whole series to the tasks, where the trees of all series of a batch grow level by level together:
sums of gradient and curvature per (series, node, feature, bin) are one ``bincount``. A feature has a bin for each
distinct value up to ``bins``, so splits of short series are those of an exhaustive search.

Row and column draws depend on the seed, the number of the tree and the place of a row in its series only, and a
cell sums the rows of one series in time order: batches and partitions do not change results.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.frame import Phase, as_predictions, series_rows
from seriesloom.operators.features import LAGS, WINDOWS, feature_names, model_features
from seriesloom.session import union

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMORY = LEAST = 13
#: Histogram cells that the series grown together may have; bounds the memory of a task.
CELLS = 1 << 18
#: Smallest gain for which a node is split.
LEAST_GAIN = 1e-6
#: Gains that differ by less than this part are the same but for rounding.
SAME_GAIN = 1e-10

GIVEN = ["state", "phase", "steps", "n_fit", "last_date", "actuals", "history"]
FITTED = "base double, feature array<int>, threshold array<double>, leaf array<double>, gain array<double>, error string"


@dataclass(frozen=True)
class Growth:
    """Settings of the trees; the first five and the penalties are those of the classic competition."""

    max_iterations: int = 300
    maxDepth: int = 4
    stepSize: float = 0.05
    subsamplingRate: float = 0.8
    columnsRate: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    least_weight: float = 1.0
    bins: int = 256
    seed: int = 42


def training_designs(frame: DataFrame, phase: str) -> DataFrame:
    """Per series the flat array ``design`` of its rows in time order: features, then the value."""
    rows = frame.filter((F.col("phase") == phase) & F.col("fit")).select("state", "date", "total")
    cells = ", ".join(f"cast({name} as double)" for name in [*feature_names(), "sales"])
    listed = f"array_sort(collect_list(struct(date, array({cells}) as cells)))"
    wide = model_features(rows, known_growth_only=True)
    return wide.groupBy("state").agg(F.expr(f"flatten(transform({listed}, r -> r.cells)) as design"))


def inputs(frame: DataFrame, phases: tuple[Phase, ...]) -> DataFrame:
    """One row per series and phase of at least ``LEAST`` months; a series without a complete row has an empty design.

    Growing trees is far more work than moving these rows, so they are dealt over all shuffle partitions.
    """
    parts = []
    for phase in phases:
        rows = series_rows(frame.filter(F.col("phase") == phase.name), {"total": MEMORY}).filter(f"n_fit >= {LEAST}")
        known = rows.withColumnRenamed("total_tail", "history").select(*GIVEN)
        made = known.join(training_designs(frame, phase.name), "state", "left")
        parts.append(made.withColumn("design", F.expr("coalesce(design, array())")))
    spread = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return union(parts).repartition(spread, "state", "phase")


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between neighbouring distinct values, evenly thinned out beyond ``bins`` bins."""
    distinct = np.unique(values)
    between = distinct[:-1] + (distinct[1:] - distinct[:-1]) / 2
    if len(between) >= bins:
        between = between[np.linspace(0, len(between) - 1, bins - 1).astype(int)]
    return between


def _shrunk(gradient: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def _divided(top: np.ndarray, curvature: np.ndarray, l2: float) -> np.ndarray:
    below = curvature + l2
    return np.divide(top, below, out=np.zeros_like(top), where=below > 0)


def _score(gradient: np.ndarray, curvature: np.ndarray, s: Growth) -> np.ndarray:
    return _divided(np.square(np.maximum(np.abs(gradient) - s.l1, 0.0)), curvature, s.l2)


def _split(gradient, cells, shape, s: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, bin, gain) of the best split of every node; bins above the given one go right.

    Columns often part the rows alike; of gains that are equal but for rounding the first wins, whatever the order of sums.
    Only bins that hold a row are looked at: a split behind an empty bin is that behind the last bin with a row.
    """
    size, nodes, most_bins = int(np.prod(shape)), shape[0], shape[2]
    h = np.bincount(cells.ravel(), minlength=size).reshape(shape)
    g = np.bincount(cells.ravel(), np.broadcast_to(gradient[:, None], cells.shape).ravel(), size).reshape(shape).cumsum(axis=2)
    used = np.flatnonzero(h)
    h = h.cumsum(axis=2)
    node, within = np.divmod(used, shape[1] * most_bins)
    whole_g, whole_h = g[:, 0, -1], h[:, 0, -1].astype(float)
    whole = _score(whole_g, whole_h, s)
    low_g, low_h = g.ravel()[used], h.ravel()[used].astype(float)
    high_g, high_h = whole_g[node] - low_g, whole_h[node] - low_h
    gain = (_score(low_g, low_h, s) + _score(high_g, high_h, s) - whole[node]) / 2
    least = max(s.least_weight, 1.0)
    gain[(low_h < least) | (high_h < least)] = -np.inf
    best, at = np.full(nodes, -np.inf), np.zeros(nodes, int)
    if len(used):
        known, start = np.unique(node, return_index=True)
        best[known] = np.maximum.reduceat(gain, start)
        near = np.flatnonzero(gain >= (best - SAME_GAIN * (np.abs(best) + whole))[node])
        known, first = np.unique(node[near], return_index=True)
        at[known] = within[near[first]]
    return at // most_bins, at % most_bins, best


def grow(designs: list[np.ndarray], s: Growth) -> dict[str, np.ndarray]:
    """Trees of several series: ``base``, per tree and inner node ``feature`` and ``threshold``, per tree and ``leaf`` a
    weight, per feature the summed ``gain``.

    Trees are complete: a node without a worthwhile split sends all its rows left, which leaves them one leaf.
    """
    many, width, inner = len(designs), designs[0].shape[1] - 1, 2**s.maxDepth - 1
    owner = np.repeat(np.arange(many), [len(d) for d in designs])
    place = np.concatenate([np.arange(len(d)) for d in designs])
    cuts = [[cuts_of(d[:, f], s.bins) for f in range(width)] for d in designs]
    codes = np.concatenate([np.stack([np.searchsorted(c, d[:, f], "right") for f, c in enumerate(cs)], 1) for d, cs in zip(designs, cuts)])
    levels = max(2, 1 + max(len(c) for cs in cuts for c in cs))
    edges = np.full((many, width, levels - 1), np.inf)
    for i, cs in enumerate(cuts):
        for f, c in enumerate(cs):
            edges[i, f, : len(c)] = c
    y = np.concatenate([d[:, -1] for d in designs])
    base = np.bincount(owner, y, many) / np.bincount(owner, minlength=many)
    made = {
        "base": base,
        "feature": np.zeros((many, s.max_iterations, inner), np.int32),
        "threshold": np.full((many, s.max_iterations, inner), np.inf),
        "leaf": np.zeros((many, s.max_iterations, inner + 1)),
        "gain": np.zeros((many, width)),
    }
    fitted = base[owner]
    for tree in range(s.max_iterations):
        draw = np.random.default_rng([s.seed, tree])
        columns = np.sort(draw.permutation(width)[: max(1, round(s.columnsRate * width))])
        hits = (draw.random(int(place.max()) + 1) < s.subsamplingRate)[place].astype(float)
        drawn = np.flatnonzero(hits)
        gradient = (fitted - y) * hits
        node = np.zeros(len(y), int)
        for depth in range(s.maxDepth):
            wide = 2**depth
            at = owner * wide + node
            cells = (at[:, None] * len(columns) + np.arange(len(columns))) * levels + codes[:, columns]
            column, cut, gain = _split(gradient[drawn], cells[drawn], (many * wide, len(columns), levels), s)
            good = gain > LEAST_GAIN
            feature, cut = columns[column], np.where(good, cut, levels)
            series, heap = np.divmod(np.arange(many * wide), wide)
            edge = np.where(good, edges[series, feature, np.minimum(cut, levels - 2)], np.inf)
            made["feature"][series, tree, wide - 1 + heap] = feature
            made["threshold"][series, tree, wide - 1 + heap] = edge
            np.add.at(made["gain"], (series[good], feature[good]), gain[good])
            node = 2 * node + (codes[np.arange(len(y)), feature[at]] > cut[at])
        at = owner * (inner + 1) + node
        size = many * (inner + 1)
        g, h = np.bincount(at, gradient, size), np.bincount(at, hits, size)
        weight = -s.stepSize * _divided(_shrunk(g, s.l1), h, s.l2)
        made["leaf"][:, tree, :] = weight.reshape(many, -1)
        fitted = fitted + weight[at]
    return made


def value_of(base, feature, threshold, leaf, x: np.ndarray) -> np.ndarray:
    """Values of the trees of each series for one feature row ``x`` of each."""
    node = np.zeros(feature.shape[:2], int)
    s, t = np.ogrid[: feature.shape[0], : feature.shape[1]]
    inner = feature.shape[2]
    while inner and node.min() < inner:
        node = 2 * node + 1 + (x[s, feature[s, t, node]] >= threshold[s, t, node])
    return base + leaf[s, t, node - inner].sum(axis=1)


def next_features(history: np.ndarray, month: np.ndarray, trend: np.ndarray) -> np.ndarray:
    """``feature_names`` of the row behind each history; ``month`` counts months from year 0."""
    columns = [history[:, -k] for k in LAGS]
    for k in WINDOWS:
        recent = history[:, -k:]
        columns += [recent.mean(axis=1), recent.std(axis=1, ddof=1)]
    of_year = month % 12 + 1
    angle = 2 * np.pi * of_year / 12
    columns += [of_year, (of_year + 2) // 3, month // 12, trend, np.sin(angle), np.cos(angle)]
    then = history[:, -13]
    growth = np.divide(history[:, -1], then, out=np.ones_like(then), where=then != 0) - 1
    return np.column_stack([*columns, growth]).astype(float)


def _chunks(designs: list[np.ndarray], s: Growth) -> Iterator[list[int]]:
    """Runs of series whose histograms together stay below ``CELLS``."""
    run: list[int] = []
    deepest = 1
    for i, design in enumerate(designs):
        deepest = max(deepest, min(len(design), s.bins))
        if run and (len(run) + 1) * 2 ** max(s.maxDepth - 1, 0) * design.shape[1] * deepest > CELLS:
            yield run
            run, deepest = [], min(len(design), s.bins)
        run.append(i)
    if run:
        yield run


def _fitted(s: Growth, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            designs = [np.asarray(v.as_py(), float).reshape(-1, width + 1) for v in batch.column("design")]
            sound = [i for i, d in enumerate(designs) if len(d) and np.isfinite(d).all()]
            rows: list[dict] = [{"error": "its values or design are not finite"} for _ in designs]
            for chunk in _chunks([designs[i] for i in sound], s):
                places = [sound[i] for i in chunk]
                made = grow([designs[i] for i in places], s)
                for j, i in enumerate(places):
                    rows[i] = {name: value[j].ravel().tolist() if value.ndim > 1 else float(value[j]) for name, value in made.items()}
            kinds = [pa.float64(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3, pa.string()]
            names = ["base", "feature", "threshold", "leaf", "gain", "error"]
            arrays = [pa.array([r.get(name) for r in rows], kind) for name, kind in zip(names, kinds)]
            given = [batch.column(name) for name in GIVEN]
            yield pa.RecordBatch.from_arrays([*given, *arrays], [*GIVEN, *names])

    return run


def fit(frame: DataFrame, phases: tuple[Phase, ...], **settings) -> DataFrame:
    """One row per series and phase with its trees as arrays, or the ``error`` why there are none. It can be stored as it is."""
    rows = inputs(frame, phases)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*GIVEN).schema.fields)
    return rows.select(*GIVEN, "design").mapInArrow(_fitted(Growth(**settings), len(feature_names())), f"{kept}, {FITTED}")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk forward: every forecast joins the history that the next step sees."""
    for batch in batches:
        rows = batch.to_pylist()
        paths: list[list[float] | None] = [None] * len(rows)
        for i, row in enumerate(rows):
            if row["error"] is not None:
                continue
            trees = len(row["leaf"]) - len(row["feature"])
            feature = np.asarray(row["feature"], int).reshape(1, trees, -1)
            threshold = np.asarray(row["threshold"], float).reshape(feature.shape)
            leaf = np.asarray(row["leaf"], float).reshape(1, trees, -1)
            history, last = np.asarray([row["history"]], float), row["last_date"]
            month = last.year * 12 + last.month - 1
            path = []
            for step in range(1, row["steps"] + 1):
                x = next_features(history, np.array([month + step]), np.array([row["n_fit"] + step - 1]))
                value = np.maximum(value_of(np.array([row["base"]]), feature, threshold, leaf, x), 0.0)
                history = np.column_stack([history[:, 1:], value])
                path.append(float(value[0]))
            paths[i] = path
        kept = ["state", "phase", "last_date", "actuals", "error"]
        arrays = [*[batch.column(name) for name in kept], pa.array(paths, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, [*kept, "yhat"])


def predict(fitted: DataFrame, model: str) -> DataFrame:
    """Predictions out of a table of ``fit``, and one row with the column ``error`` for each series without trees."""
    types = {f.name: f.dataType.simpleString() for f in fitted.schema.fields}
    kept = ", ".join(f"{name} {types[name]}" for name in ("state", "phase", "last_date", "actuals", "error"))
    return as_predictions(fitted.mapInArrow(_walked, f"{kept}, yhat array<double>"), model, "yhat", F.col("error"))


def importance(fitted: DataFrame) -> DataFrame:
    """Share of each feature in the summed gain, per series and phase; 0 for a series without splits."""
    names = F.array(*[F.lit(name) for name in feature_names()])
    whole = F.expr("aggregate(gain, 0D, (a, x) -> a + x)")
    shares = F.transform("gain", lambda g: F.when(F.col("whole") > 0, g / F.col("whole")).otherwise(0.0))
    rows = fitted.filter("error is null").withColumn("whole", whole)
    return rows.select("state", "phase", F.inline(F.arrays_zip(names.alias("feature"), shares.alias("importance"))))


def parameters(**settings) -> dict[str, str]:
    return {name: str(value) for name, value in asdict(Growth(**settings)).items()}
