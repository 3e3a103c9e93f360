"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in a cycle; each step fits a tree
of at most three leaves to the gradient of one feature and adds it to that feature's lookup table.
Then the pairs of features whose joint cut explains most of the rest get tables of their own in
the same way. A score is the sum of one table entry per term, so it is a few array lookups.

Features describe the whole text only. The fit reads a bounded sample (``labelled.SAMPLE_ROWS``);
scoring is one pass over all documents without a shuffle. Defined cases: a NULL or empty text has
all features 0 and is scored like any other; without labels of both classes the score is the
smoothed share of label 1 everywhere; NULL ids, repeated rows and extra columns pass; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import add_columns, in_arrow, map_texts, texts_of
from seriesloom.llm.labelled import SAMPLE_ROWS, labelled_texts, training_sample

BINS, ROUNDS, RATE, PAIR_BINS, PAIRS, PAIR_ROUNDS = 32, 120, 0.1, 8, 6, 40
#: Ridge on leaf values, and least hessian of a leaf.
RIDGE, LEAST = 1.0, 1.0

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "newline", "stop_mark", "symbol",
    "beyond_ascii", "distinct_words", "top_word", "distinct_lines", "line_length", "short_words", "entropy",
    "marked_words", "bars",
)

_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 7
_MARKED = re.compile(r"[^\w\s.,;:?'\"()\-]{2,}(?:\s|\Z)")


def features(text: str) -> list[float]:
    """Values of ``FEATURES`` for one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=8) / len(raw)
    present = counts[counts > 0] / len(raw)
    words = text.split()
    tally = Counter(words)
    lines = text.split("\n")
    n = max(1, len(words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, *shares[1:8],
        len(tally) / n, max(tally.values(), default=0) / n, len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)), sum(v for w, v in tally.items() if len(w) <= 3) / n,
        float(-(present * np.log2(present)).sum()), len(_MARKED.findall(text)) / n, text.count("|") / n,
    ]


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    """Bin edges, lookup tables per feature and per pair, and the intercept."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            i, j = (np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in (a, b))
            total += table[i, j]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gains = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
    gains[(left_h < LEAST) | (right_h < LEAST)] = 0
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree with at most three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = max(((*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda c: c[0])
        gain, at, a, b = best
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a depth-two tree: a cut of the first feature, then one of the second on each side.

    All first cuts are tried, as an interaction need not show in either feature alone.
    """
    whole = _gain(g.sum(), h.sum())
    best, sides = -1.0, []
    for at in range(len(g)):
        tried, gain = [], -whole
        for rows in (slice(0, at), slice(at, None)) if at else (slice(None),):
            side_g, side_h = g[rows].sum(axis=0), h[rows].sum(axis=0)
            more, cut = _best_cut(side_g, side_h)
            gain += _gain(side_g.sum(), side_h.sum()) + more
            tried.append((rows, cut if more > 0 else 0, side_g, side_h))
        if gain > best and all(t[3].sum() >= LEAST for t in tried):
            best, sides = gain, tried
    out = np.zeros_like(g)
    for rows, cut, side_g, side_h in sides:
        for columns in (slice(0, cut), slice(cut, None)):
            out[rows, columns] = side_g[columns].sum() / (side_h[columns].sum() + RIDGE)
    return best, out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of main tables, then of the chosen pairs' tables."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges, model.pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _shallow_tree(
                np.bincount(bins[f], weights=g, minlength=len(table)), np.bincount(bins[f], weights=h, minlength=len(table))
            )
            table += step
            total += step[bins[f]]

    def joint(a, b, values):
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights=values, minlength=shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(
        combinations(range(x.shape[1]), 2), key=lambda p: -_pair_tree(joint(*p, g), joint(*p, h))[0]
    )
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _pair_tree(joint(a, b, g), joint(a, b, h))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "quality", bound: int = SAMPLE_ROWS) -> Gam:
    """A model from at most ``bound`` labelled rows that ``allowed`` (on ``labels``) admits."""
    texts = labelled_texts(docs, training_sample(labels, label_col, allowed, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _matrix(texts_of(batch.column(1)))
            values = pa.array(list(made), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], ["doc_id", "label", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = in_arrow(texts, run, f"doc_id {kind}, label int, x array<double>").dropDuplicates(["doc_id"])
    got = sorted((str(r.doc_id), r.label, r.x) for r in rows.collect())
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r[1] for r in got], float))


def score(
    docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None
) -> DataFrame:
    """One row per document: its score between 0 and 1. With ``keep``, all columns and the score under that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str]) -> list:
        return [shared.value.scores(_matrix(texts))]

    if keep:
        return add_columns(docs, f"{keep} double", rows, text_col)
    return map_texts(docs, "score double", rows, id_col, text_col)


def decided(scored: DataFrame, remainder: Column, held: int, threshold: float = 0.3) -> DataFrame:
    """Adds held_out (whether ``remainder`` is ``held``) and predicted (1 from ``threshold`` on)."""
    return scored.select(
        "doc_id",
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
