"""Exact top-k search by inner product with vector-approximation files.

Every vector is cut into blocks of rows. A block keeps, per component, cell borders and the cell number of
each vector (its approximation). A query first scans the cells: each cell's borders give a lower and an
upper bound of the inner product. Vectors are then read exactly in order of their best possible score, until
the k-th score found is beyond what any vector not yet read can reach. Blocks give their k best, which are
ranked together, so the result is that of comparing all pairs.

All numbers are integers. Products whose sums stay below 2^53 are exact in double precision; for larger ones the bounds
are widened by their rounding and the vectors that are read are multiplied as integers of any size, so scores are
exact and ties go to the smaller id. Only a score beyond the range of long stops the job. Queries and vectors meet block by block: every block of queries
with every block of vectors, which is the stated query set against all rows. Block sizes bound the memory
of a task whatever the input.

Defined cases: NULL vectors or ids and vectors with NULL or non-finite components take no part, as query or
as candidate; a query is compared with vectors of its own length only; every row but the query's own
is a candidate, whatever its id and values, so repeated rows are candidates of each other, fill a rank each and, if they
are queries, get an answer each; scaled values beyond the range of doubles take no part; with fewer than k candidates all are returned; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, workers_import

#: Vectors and queries of a block, and cells per component.
BLOCK, QUERY_BLOCK, CELLS = 4096, 1024, 64
#: Vectors read exactly at a time.
READ = 32
#: Sums of products stay exact below this.
EXACT = float(1 << 53)


def cells_of(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of each component, and the lowest and highest value in each cell (components x cells)."""
    ranks = np.linspace(0, 1, cells + 1)[1:-1]
    numbers = np.empty(x.shape, np.uint8)
    low, high = np.zeros((x.shape[1], cells)), np.zeros((x.shape[1], cells))
    for d, column in enumerate(x.T):
        numbers[:, d] = np.searchsorted(np.quantile(column, ranks), column, side="right")
        for c in np.unique(numbers[:, d]):
            inside = column[numbers[:, d] == c]
            low[d, c], high[d, c] = inside.min(), inside.max()
    return numbers, low, high


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one vector, exactly: in doubles where all sums stay whole, else in integers of any size."""
    if not x.size or np.abs(x).max() * np.abs(q).max() * len(q) < EXACT:
        return x @ q
    whole = [int(v) for v in q]
    return np.array([sum(int(v) * w for v, w in zip(row, whole, strict=True)) for row in x], object)


def _best(got: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id and row."""
    if got.dtype != object:
        return np.lexsort((rows, ids, -got))[:k]
    return np.array(sorted(range(len(got)), key=lambda i: (-got[i], ids[i], rows[i]))[:k], np.int64)


def search_block(
    query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The k best of each query in one block of vectors: place of the query, place of the vector, score.

    Rows are told apart by their row numbers, so vectors with the query's id, or equal to it, are candidates.
    """
    numbers, low, high = cells_of(x)
    dims = np.arange(x.shape[1])
    lowest, highest = low[dims, numbers], high[dims, numbers]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    most = up @ highest.T + down @ lowest.T
    least = up @ lowest.T + down @ highest.T
    largest = np.maximum(np.abs(lowest), np.abs(highest))
    if largest.max() * np.abs(queries).max() * x.shape[1] >= EXACT:
        # sums that are not whole are off by a small part of the sum of their terms
        slack = np.abs(queries) @ largest.T * (x.shape[1] + 2) * 2.0**-51
        most, least = most + slack, least - slack
    out: tuple[list, list, list] = ([], [], [])
    for q, row in enumerate(query_rows):
        other = rows != row
        bound = np.where(other, most[q], -np.inf)
        sure = np.where(other, least[q], -np.inf)
        if len(rows) > k:
            floor = np.partition(sure, len(rows) - k)[len(rows) - k]
            taken = np.flatnonzero((bound >= floor) & other)
        else:
            taken = np.flatnonzero(other)
        order = taken[np.argsort(-bound[taken], kind="stable")]
        places, got = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(order), READ):
            if len(got) == k and got[-1] > bound[order[a]]:
                break
            read = order[a : a + READ]
            places, got = np.concatenate([places, read]), np.concatenate([got, products(x[read], queries[q])])
            best = _best(got, ids[places], rows[places], k)
            places, got = places[best], got[best]
        out[0].append(np.full(len(got), q))
        out[1].append(places)
        out[2].extend(int(v) for v in got)
    whole = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out[:2]]
    if any(abs(v) >= 1 << 63 for v in out[2]):
        raise ValueError("a score is too large for a long integer")
    return whole[0], whole[1], out[2]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def prepare(rows: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, v): vectors as integers floor(scale * x), those that take part only."""
    x = F.col("x")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(scale))) == float("inf"))) & (F.size("x") > 0)
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & good)
    scaled = lambda c: c * F.lit(float(scale))
    # doubles from 2^53 on are whole, and beyond 2^63 floor has no long to give
    whole = lambda c: F.when(F.abs(scaled(c)) >= EXACT, scaled(c)).otherwise(F.floor(scaled(c)).cast("double"))
    return rows.select("id", F.size("x").alias("dim"), F.transform("x", whole).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (id, dim, v) of integers; ``is_query`` is a condition on id.

    Raises if a score that is among the best of a block is beyond the range of long.
    """
    workers_import(vectors.sparkSession)
    vectors = checkpointed(vectors.withColumn("row", F.monotonically_increasing_id()))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, query_blocks = max(1, -(-size.n // BLOCK)), max(1, -(-size.q // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    query_block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("id", "row", "dim", "v", block.cast("int").alias("b")).withColumn("qb", every(query_blocks))
    # columns of their own: a cogroup whose sides share columns loses those of the right side when its result is projected
    own = [F.col(name).alias(f"query_{name}") for name in ("id", "row", "dim", "v")]
    asked = vectors.filter(is_query).select(*own, query_block.cast("int").alias("qb")).withColumn("b", every(blocks))
    kind = vectors.schema["id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if left.num_rows and right.num_rows:
            names, numbers = left.column("id").to_numpy(), left.column("row").to_numpy()
            at, place, score = search_block(
                right.column("query_row").to_numpy(), _matrix(right.column("query_v")), numbers, names, _matrix(left.column("v")), k
            )
        arrays = [
            right.column("query_row").take(pa.array(at)), right.column("query_id").take(pa.array(at)),
            left.column("row").take(pa.array(place)), left.column("id").take(pa.array(place)), pa.array(score, pa.int64()),
        ]
        return pa.Table.from_arrays(arrays, ["query_row", "query_id", "row", "vec_id", "score"])

    made = f"query_row long, query_id {kind}, row long, vec_id {kind}, score long"
    found = rows.groupBy("b", "qb", "dim").cogroup(asked.groupBy("b", "qb", "query_dim")).applyInArrow(meet, made)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
