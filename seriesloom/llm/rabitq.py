"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A vector o of length 1 is turned by a random rotation; the signs of its coordinates, scaled to length
1, are its code c. With the stored factor f = <c, o>, the number <c, q> / f is an unbiased estimate of
<o, q>, whose error is at most eps * sqrt((1 - f * f) / (f * f * (D - 1))) but for a chance that falls
off as exp(-eps * eps / 2). A pair whose upper bound is below the threshold is left out; every other
pair is computed anew in double precision, so no link below the threshold is ever made.

Which pairs are looked at at all: the code bits of ``rotations`` rotations, cut into tables of ``bits``
bits each, are bucket keys. Two vectors at cosine t agree in a bit with probability
p = 1 - arccos(t) / pi. ``bits`` grows with the logarithm of the largest label and the number of
tables is what keeps the chance of missing a pair at the threshold below ``MISS``, so the work
grows as n to the power 1 + log(1/p) / log 2 (1.18 at 0.93), not with the square of a label. A
pair counts in the first table in which it meets, so counts need no list of pairs.

Equal vectors of a label become one node first. Buckets of more than ``BLOCK`` nodes are cut into
blocks that meet pairwise, so a hot bucket spreads over tasks. A block gives counts per vector and
one link per vector towards the smallest vector of its part, never its pairs.

Defined cases: NULL vectors, labels or ids, zero vectors and vectors with NULL or non-finite components
link with nothing (n_links 0, a component of their own), as do vectors of different lengths; rows that
share an id count as one, their links add up; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, in_arrow
from seriesloom.llm.components import components

#: Chance of missing a pair exactly at the threshold; closer pairs are missed far less often.
MISS = 0.001
#: Error of the estimate that is allowed for, in standard deviations.
EPS = 4.5
#: Nodes of a bucket compared in one block, and the mean number of nodes per bucket aimed at.
BLOCK, FILL = 512, 0.125
SEED = 11


@cache
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions."""
    rng = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)])


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables for a label of ``largest`` vectors."""
    bits = min(48, max(4, math.ceil(math.log2(max(2, largest) / FILL))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))


def unit_rows(column: pa.Array) -> list[np.ndarray]:
    """Usable vectors brought to length 1 in double precision."""
    rows = []
    for value in column:
        x = value.values.to_numpy(zero_copy_only=False).astype(float)
        x = x / np.abs(x).max()
        rows.append(x / math.sqrt(float(x @ x)))
    return rows


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket keys (rows x tables) from the signs of rotated vectors."""
    dim = x.shape[1]
    turned = rotations(dim, -(-bits * tables // dim))
    signs = np.concatenate([x @ r.T > 0 for r in turned], axis=1)[:, : bits * tables]
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    return (signs.reshape(len(x), tables, bits) * weights).sum(axis=2)


def close_pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of rows have a cosine of at least ``threshold``.

    Bounds from the codes leave out pairs; the others are recomputed.
    """
    dim = x.shape[1]
    turned = x @ rotations(dim, 1)[0].T
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
    factor = (code * turned).sum(axis=1)
    error = EPS * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        bound = np.einsum("nd,nd->n", code[p], turned[q]) / factor[p] + error[p]
        maybe = np.flatnonzero(bound >= threshold)
        out[a + maybe] = np.einsum("nd,nd->n", x[p[maybe]], x[q[maybe]]) >= threshold
    return out


def _least_in_part(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n numbers by links (i, j)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            return least


def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(label, node, copies, vector) -> the vector as float64 bytes with its length and keys in its place."""
    for batch in batches:
        rows = unit_rows(batch.column(3))
        keys: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        for dim in {len(r) for r in rows}:
            at = [k for k, r in enumerate(rows) if len(r) == dim]
            for k, made in zip(at, table_keys(np.stack([rows[k] for k in at]), bits, tables), strict=True):
                keys[k] = made
        units = pa.array([r.tobytes() for r in rows], pa.binary())
        dims = pa.array([len(r) for r in rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], dims, units, pa.array(keys, pa.list_(pa.int64()))],
            ["label", "node", "copies", "dim", "unit", "keys"],
        )


class _Block:
    """Rows of one block: a bucket, or two parts of a hot bucket that meet."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.rows: list[tuple] = []

    def links(self) -> tuple[np.ndarray, ...] | None:
        """Ids, multiplied link counts and least ids of the vectors that have links."""
        if len(self.rows) < 2:
            return None
        ids = np.array([r[0] for r in self.rows])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        rows = [self.rows[k] for k in order]
        copies = np.array([r[1] for r in rows], np.int64)
        part = np.array([r[2] for r in rows])
        low, high, table = self.rows[0][3:6]
        keys = np.stack([r[7] for r in rows])
        x = np.stack([np.frombuffer(r[6], float) for r in rows])
        i, j = np.triu_indices(len(rows), 1)
        if low != high:
            across = part[i] != part[j]
            i, j = i[across], j[across]
        good = close_pairs(x, i, j, self.threshold)
        i, j = i[good], j[good]
        new = np.ones(len(i), bool)
        for k in range(0, len(i), 1 << 14):
            p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            new[k : k + (1 << 14)] = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
        i, j = i[new], j[new]
        if not len(i):
            return None
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        least = _least_in_part(len(rows), i, j)
        on = n > 0
        return ids[on], n[on], ids[least][on]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Link counts and links (a, n, b) of rows sorted by block."""
    block, now = _Block(threshold), None
    kind = None

    def out(made):
        arrays = [pa.array(made[0], kind), pa.array(made[1], pa.int64()), pa.array(made[2], kind)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "n", "b"])

    for batch in batches:
        kind = batch.schema.field("node").type
        columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names) if name != "keys"}
        keys = batch.column(batch.schema.names.index("keys"))
        for k in range(batch.num_rows):
            name = tuple(columns[c][k] for c in ("label", "dim", "t", "key", "low", "high"))
            if name != now:
                if now is not None and (made := block.links()):
                    yield out(made)
                block, now = _Block(threshold), name
            block.rows.append(
                (columns["node"][k], columns["copies"][k], columns["part"][k], columns["low"][k], columns["high"][k],
                 columns["t"][k], columns["unit"][k], keys[k].values.to_numpy())
            )
    if now is not None and (made := block.links()):
        yield out(made)


def near_vectors(
    rows: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: n_links, component_id and kept, comparing vectors of equal labels."""
    narrow = rows.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")
    )
    plain = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), float("nan")).otherwise(F.abs(x)))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (plain > 0) & ~F.isnan(plain)
    tagged = narrow.withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes = checkpointed(
        tagged.filter("usable").groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    )
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold)
    kind = nodes.schema["node"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    coded = checkpointed(
        in_arrow(
            nodes.select("label", "node", "copies", "v"),
            lambda b: _codes(b, bits, tables),
            f"label {label}, node {kind}, copies long, dim int, unit binary, keys array<long>",
        )
    )
    entries = coded.select("label", "dim", "node", "copies", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    sizes = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / BLOCK)
    met = (
        entries.join(sizes, bucket)
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("node", "t"), "parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .select(*bucket, "low", "high", "part", "node", "copies")
    )
    carried = met.join(coded.select("node", "label", "dim", "unit", "keys"), ["node", "label", "dim"])
    block = [*bucket, "low", "high"]
    found = checkpointed(
        in_arrow(
            carried.repartition(*block).sortWithinPartitions(*block),
            lambda b: _compare(b, threshold),
            f"a {kind}, n long, b {kind}",
        )
    )
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    group = components(found.select("a", "b"))
    by_node = (
        nodes.join(counts, "node", "left")
        .join(group, "node", "left")
        .select(
            "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    joined = tagged.filter("usable").join(by_node, ["label", "v"]).select("id", "n_links", "component_id")
    alone = tagged.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
