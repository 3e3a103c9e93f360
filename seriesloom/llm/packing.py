"""Best-fit packing of documents into sequences of several permitted lengths.

Documents have lengths (tokens, words, bytes). One longer than the largest capacity is cut into full
pieces and a rest, so nothing is lost. Pieces are packed longest first, each into the open bin that it
leaves the least room in; if none fits, a bin is opened. Which size to open is a joint choice over all
permitted capacities: the one with the least cost per filled token, taking the room that the pieces still
to come can fill into account. At the end every bin is downsized to the smallest capacity that holds its
contents. The cost of a bin is its capacity plus ``OVERHEAD`` tokens.

Packing is done per shard: pieces are dealt over shards of about ``SHARD`` pieces by a hash, so a shard fits a
task and shards run side by side; a bin is named by shard and number. Rows of equal id (or none) and length are
counted first and dealt in lots of at most ``LOT``, so that repeated and NULL ids spread over the shards too. Within a shard, pieces of
one length are interchangeable, so best fit works on counts per room and takes time linear in pieces and
capacity.

Defined cases: a NULL length counts as 0, a document of length 0 is one empty piece in a bin; rows with a
NULL id are packed like others; repeated rows are packed each; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import in_arrow

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 8
SHARD = 4096
LOT = 64


def opened(length: int, rest: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> int:
    """The capacity to open for a piece of ``length``: least cost per token that the bin will hold.

    ``rest[r]`` is the number of tokens in pieces still to come of at most r tokens each; a larger bin pays
    only as far as such pieces can fill its room.
    """
    best, least = capacities[-1], float("inf")
    for capacity in capacities:
        if capacity < length:
            continue
        room = capacity - length
        fill = min(room, int(rest[min(room, len(rest) - 1)]))
        cost = (capacity + overhead) / max(1, length + fill)
        if cost < least:
            best, least = capacity, cost
    return best


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin number and offset of every piece, and the final capacity of every bin.

    Pieces must be no longer than the largest capacity.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    top = capacities[-1]
    # tokens of the pieces still to come, by their length: a running sum of those up to a room
    tokens = np.bincount(np.array(lengths, np.int64), weights=np.array(lengths, float), minlength=top + 1) if lengths else np.zeros(top + 1)
    upto = np.cumsum(tokens)
    rooms: list[tuple[int, int]] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    size: list[int] = []
    filled: list[int] = []
    for i in order:
        n = lengths[i]
        upto[n:] -= n
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(size)
            room = opened(n, upto, capacities)
            size.append(room)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        insort(rooms, (room - n, b))
    return bins, offsets, [min(c for c in capacities if c >= f) for f in filled]


def pack_documents(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: id, piece (from 0), start (within the document), length, bin (shard and number),
    bin_offset and capacity."""
    top = max(capacities)
    capacities = tuple(sorted(capacities))
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0))
    zero = F.lit(0).cast("long")
    equal = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("c"))
    lots = equal.select("id", "n", "c", F.explode(F.sequence(zero, F.expr(f"(c - 1) div {LOT}"))).alias("lot"))
    pieces = lots.select("*", F.explode(F.sequence(zero, last)).alias("piece")).select(
        "id", "n", "lot", "piece", (F.col("piece") * top).alias("start"),
        F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("length"),
        F.least(F.lit(LOT), F.col("c") - F.col("lot") * LOT).alias("copies"),
    )
    total = rows.agg(F.sum(F.greatest(F.ceil(F.col("n") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    kind = pieces.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and shard[a] != now:
                    yield _packed(held, capacities)
                    held = []
                now = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _packed(held, capacities)

    shard = F.pmod(F.xxhash64("id", "n", "lot", "piece"), F.lit(shards)).alias("shard")
    dealt = pieces.select(shard, "id", "piece", "start", "length", "copies").repartition("shard")
    each = dealt.select("shard", "id", "piece", "start", "length", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    packed = in_arrow(
        each.drop("col").sortWithinPartitions("shard", F.desc("length"), "id", "piece"), run,
        f"id {kind}, piece long, start long, length long, shard long, number long, bin_offset long, capacity long",
    )
    return packed.select(
        F.col("id").alias(id_col), "piece", "start", "length",
        F.concat_ws("-", "shard", "number").alias("bin"), "bin_offset", "capacity",
    )


def _packed(held: list[pa.RecordBatch], capacities: tuple[int, ...]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    bins, offsets, sizes = pack(rows.column(4).to_pylist(), capacities)
    made = [bins, offsets, [sizes[b] for b in bins]]
    return pa.RecordBatch.from_arrays(
        [*rows.columns[1:], rows.column(0).cast(pa.int64()), *(pa.array(m, pa.int64()) for m in made)],
        ["id", "piece", "start", "length", "shard", "number", "bin_offset", "capacity"],
    )
