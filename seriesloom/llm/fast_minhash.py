"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``BINS`` coordinates. In round i every shingle is hashed to one bin and leaves its hash
there if the bin is empty or holds a larger hash of the same round; rounds go on until no bin is
empty. Rounds from ``BINS`` on send every shingle to one bin each, so after 2 * ``BINS`` rounds at most
every coordinate is filled. Two sketches agree in a coordinate with the probability of the Jaccard
similarity, with concentration as if the coordinates were independent. A sketch costs about one hash
per shingle, not one per shingle and coordinate.

Bands of ``ROWS`` coordinates give bucket keys. At similarity 0.75 a pair shares no bucket of the
48 with a probability of 8e-5. Every pair that shares a bucket is either compared on its full
shingle sets, ruled out by the sizes of the sets, or already in one component, so nothing is lost
behind the buckets:

1. Equal sets become one node (their smallest id), combined before the shuffle.
2. Every node is compared with the pivot of each of its buckets; the links give components.
3. In buckets that still hold several components, all pairs of different components are compared, block by block:
   the sketches rule out pairs whose similarity they bound below 0.75 by five deviations (a chance of
   3e-7), full sets decide the others. Only links that join components leave a block.

A group of near copies therefore costs about one comparison per node and band; only what stays apart close to the
threshold is compared pair by pair, and no pair is a row. Comparisons with one node are dealt over tasks in
lots of ``LOT``, so a hot group spreads.

Defined cases: NULL, empty and blank texts have empty sets and link with nothing; rows with a NULL
id take no part (component NULL, kept); rows that share an id count as one node; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, in_arrow, map_texts, slices, texts_of
from seriesloom.llm.components import components
from seriesloom.llm.shingles import mix, shingle_sets

BINS, ROWS = 288, 6
#: Links need 100 * intersection >= SHARE * union.
SHARE = 75
#: Comparisons with one node that a task takes at a time.
LOT = 128
#: Nodes of a bucket that are compared pair by pair in one task, and deviations that a sketch's estimate must be off.
BLOCK, SIGMAS = 512, 5
#: Bytes of text hashed at a time.
SLICE = 2 << 20

_RNG = np.random.default_rng(7)
_SEEDS = _RNG.integers(1, 1 << 63, 2 * BINS, dtype=np.uint64)
_ROW = _RNG.integers(1, 1 << 63, (BINS // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` coordinates per set; an empty set's coordinates stay at the largest number."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), BINS), _EMPTY, np.uint64)
    cells = out.reshape(-1)
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * BINS):
        if not len(items):
            break
        h = mix(items ^ _SEEDS[i])
        # the upper 16 bits choose the bin, the lower 48 are the value
        to = ((h >> np.uint64(48)) * np.uint64(BINS) >> np.uint64(16)).astype(np.int64) if i < BINS else i - BINS
        value = (h & np.uint64((1 << 48) - 1)) | np.uint64(i << 48)
        np.minimum.at(cells, owner * BINS + to, value)
        left = (out == _EMPTY).any(axis=1)[owner]
        items, owner = items[left], owner[left]
    return out


def band_keys(made: np.ndarray) -> np.ndarray:
    """Bucket keys of each sketch, one per band; the band is part of the key."""
    parts = made.reshape(len(made), BINS // ROWS, ROWS)
    return mix((mix(parts) * _ROW).sum(axis=2, dtype=np.uint64)).astype(np.int64)


def _sketch_rows(texts: list[str]) -> list:
    sets = shingle_sets(texts)
    keys = band_keys(sketches(sets))
    digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    return [[len(s) for s in sets], digests, list(keys)]


def _with_sets(rows: DataFrame) -> DataFrame:
    """(id, shingles, marks) of rows (id, text): the sorted hashes, and the low byte of each coordinate of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                sets = shingle_sets(texts_of(batch.column(1).slice(a, b - a)))
                marks = sketches(sets).astype(np.uint8)
                made = [pa.array([x.tobytes() for x in values], pa.binary()) for values in (sets, marks)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made], ["id", "shingles", "marks"])

    return in_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, shingles binary, marks binary")


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    """Whether two sorted sets are similar enough; sizes alone settle most pairs that are not."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < share * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= share * (len(small) + len(large) - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (hub, lot, role, id, shingles) sorted by the first three; role 0 is the hub itself."""
    hub, own = None, []
    for batch in batches:
        found: tuple[list, list] = ([], [])
        hubs, lots, roles, ids = (batch.column(i).to_pylist() for i in range(4))
        for i, raw in enumerate(batch.column(4)):
            values = np.frombuffer(raw.as_buffer(), np.uint64)
            if (hubs[i], lots[i]) != hub:
                hub, own = (hubs[i], lots[i]), []
            if roles[i] == 0:
                if not any(np.array_equal(x, values) for x in own):
                    own.append(values.copy())
            elif any(linked(x, values) for x in own):
                found[0].append(hubs[i])
                found[1].append(ids[i])
        kind = batch.column(0).type
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in found], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (hub, id, size) whose full sets (id, shingles) are similar enough, as links (a, b).

    Members of a hub are dealt into lots; the hub's set goes to each of its lots. The number of lots comes from the
    size of the bucket that the pair was found in, so no row has to meet its hub to learn it: a bucket gives a lot about
    ``LOT`` members, and a hub has at most as many buckets as there are bands.
    """
    lot = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / LOT))
    dealt = pairs.select("hub", lot.alias("lot"), "id")
    sets = sets.select("id", "shingles")
    members = dealt.join(sets, "id").select("hub", "lot", F.lit(1).alias("role"), "id", "shingles")
    hubs = dealt.select("hub", "lot", F.col("hub").alias("id")).distinct().join(sets, "id")
    rows = members.unionByName(hubs.select("hub", "lot", F.lit(0).alias("role"), "id", "shingles"))
    rows = rows.repartition("hub", "lot").sortWithinPartitions("hub", "lot", "role")
    kind = pairs.schema["id"].dataType.simpleString()
    return in_arrow(rows, _compare, f"a {kind}, b {kind}")


def _pairs(members: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct pairs (hub, id) that share a bucket and whose set sizes fit, with the size of the largest such bucket.

    members (key, id, n, size), others (key, hub, m).
    """
    fits = f"id <> hub and 100 * least(m, n) >= {SHARE} * greatest(m, n)"
    return members.join(others, "key").filter(fits).groupBy("hub", "id").agg(F.max("size").alias("size"))


def _with_pivots(shared: DataFrame) -> DataFrame:
    """Pairs of every node of a bucket with the bucket's pivot, its node of least hash."""
    pivots = shared.filter(F.xxhash64("id") == F.col("low")).select("key", F.col("id").alias("hub"), F.col("n").alias("m"))
    return _pairs(shared.select("key", "id", "n", "size"), pivots)


def _mixed(shared: DataFrame, group: DataFrame) -> DataFrame:
    """Rows (key, id, size, own) of buckets that hold several components and more than a pivot and one node."""
    placed = shared.filter("size > 2").join(group.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("key", "id", "size", F.coalesce("component", "id").alias("own"))
    mixed = placed.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x <> y").select("key")
    return placed.join(mixed, "key")


def _links_within(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a bucket, enough to join all that its pairs join.

    A bucket of more than ``BLOCK`` nodes is cut into parts that meet pairwise, so its pairs spread over tasks and
    none of them is a row.
    """
    parts = F.ceil(F.col("size") / BLOCK)
    met = mixed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "id", "own")
    carried = met.join(sets, "id").select("key", "low", "high", "id", "own", "marks", "shingles")
    kind = sets.schema["id"].dataType.simpleString()
    block = ["key", "low", "high"]
    return in_arrow(carried.repartition(*block).sortWithinPartitions(*block), _compare_blocks, f"a {kind}, b {kind}")


def block_links(own: list, marks: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that link nodes of different components; pairs joined by earlier ones are not looked at.

    Sketches rule out a pair whose similarity they bound below the threshold by ``SIGMAS`` deviations.
    """
    up: dict = {c: c for c in own}

    def top(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    sizes = np.array([len(x) for x in sets])
    least = BINS * (SHARE / 100 - SIGMAS * (SHARE / 100 * (1 - SHARE / 100) / BINS) ** 0.5)
    found = []
    for i in range(len(own) - 1):
        near = (marks[i + 1 :] == marks[i]).sum(axis=1) >= least
        near &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= SHARE * np.maximum(sizes[i + 1 :], sizes[i])
        for j in (np.flatnonzero(near) + i + 1).tolist():
            x, y = top(own[i]), top(own[j])
            if x != y and linked(sets[i], sets[j]):
                up[x] = y
                found.append((i, j))
    return found


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block_links`` of rows (key, low, high, id, own, marks, shingles) sorted by the first three."""
    now, held, kind = None, [], pa.int64()

    def out():
        pairs = block_links(
            [h[1] for h in held], np.stack([np.frombuffer(h[2], np.uint8) for h in held]), [np.frombuffer(h[3], np.uint64) for h in held]
        )
        return pa.RecordBatch.from_arrays([pa.array([held[p[k]][0] for p in pairs], kind) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        kind = batch.column(3).type
        columns = [c.to_pylist() for c in batch.columns]
        for key, low, high, *row in zip(*columns, strict=True):
            if (key, low, high) != now:
                if len(held) > 1:
                    yield out()
                now, held = (key, low, high), []
            held.append(row)
    if len(held) > 1:
        yield out()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (smallest id reachable by links), kept (whether it is that id)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = checkpointed(map_texts(narrow, "n long, set_key binary, bands array<long>", _sketch_rows, "id", "text"))
    complete = F.col("id").isNotNull() & F.col("set_key").isNotNull()
    nodes = checkpointed(
        made.filter(complete).groupBy("set_key").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
    )
    entries = nodes.select(F.col("node").alias("id"), "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.xxhash64("id")).alias("low"))
    shared = checkpointed(entries.join(buckets.filter("size > 1"), "key"))
    sets = checkpointed(_with_sets(narrow.join(shared.select("id").distinct(), "id", "left_semi")))
    pairs = checkpointed(_with_pivots(shared))
    links = checkpointed(verified(pairs, sets))
    group = components(links)
    mixed = checkpointed(_mixed(shared, group))
    if not mixed.isEmpty():
        stars = group.select(F.col("node").alias("a"), F.col("component").alias("b"))
        group = components(stars.union(_links_within(mixed, sets)))
    by_set = nodes.join(group, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    found = made.filter(complete).join(by_set, "set_key")
    alone = made.filter(~complete).withColumn("component_id", F.col("id"))
    columns = ["id", "n", "component_id"]
    return found.select(*columns).union(alone.select(*columns)).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
