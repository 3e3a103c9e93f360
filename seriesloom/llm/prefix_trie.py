"""Trie of conversation prefixes by time-forward processing.

A conversation is its turns in order. The node of depth d that a conversation passes is its first d turns, named by
a 127-bit polynomial hash of their SHA-256 digests; conversations that begin alike share nodes. Texts leave the
first pass as a digest and a size, so what is shuffled is a small part of the input.

Turns are sorted over all partitions by conversation and turn, so one conversation may lie on many of them. A partition
is summed up in at most three stretches (its first conversation, its last, and the one that the last borrows from); the
driver chains these few numbers per partition, and the walk over a partition begins with the state that the one before it
ended in. The hash of a stretch does not depend on what stands before it.

Totals of subtrees go up as messages. Nodes with more than one ``TOP``-th of all (conversation, depth) rows, at most
``TOP`` of them whatever the input, and the root form the crown; every other node belongs to the shard of its highest ancestor
outside the crown. In a shard, nodes come in reverse level order, sorted by Spark outside memory; a node takes its
children's messages from a priority queue that spills to the task's scratch space, and leaves its own total for its
parent. The totals of shard roots are added up per parent before they move, and the crown is processed in the
same way last. A node with one member is the top of a path, so its totals are known without messages, and its
parent counts it as the members that no other child and no end accounts for.

Names of nodes that a crown node passes to its children go by broadcast (at most ``TOP`` rows), all others by a shuffle, in which
no parent has more than one ``TOP``-th of the rows. Digests of the conversations that end in a node are formed of
sorted pieces of text made on all partitions, so one task reads long pieces, not rows.

Defined cases: NULL role and text count as '', NULL turns come first, equal turns go by role and then by the digest of
role and text; rows with a NULL conv_id belong to no conversation and are left out; repeated rows are turns like others;
an empty table has no nodes; extra columns are not read. Two conversations that are equal and hold a large share of all rows are
one path in one shard, whose task is long but holds one message at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import pickle
import tempfile
import zlib
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed, in_arrow

#: Most nodes of the crown, and messages that a queue holds before it spills.
TOP, HELD = 10_000, 200_000
#: Most rows in an Arrow batch that a task gives out, and characters of a piece of joined ids.
ROWS, PIECE = 20_000, 1 << 16
#: The hash of turns t1 .. tn is the sum of ti * BASE^(n - i) modulo a Mersenne prime.
PRIME = (1 << 127) - 1
BASE = 0x5A8F2D3C9E71B6445D0C1E9A7B3F6821


@dataclass(frozen=True)
class Borrowing:
    """Conversation c takes its first h turns from the one at the start of its group of ``group``, h = crc32(c) % ``span``."""

    group: int = 5
    span: int = 9

    def turns(self, conv: int, start: int) -> int:
        return 0 if conv == start else zlib.crc32(str(conv).encode()) % self.span


@dataclass
class Stretch:
    """Consecutive turns of one conversation: their number, their hash, and the first few (digest, size)."""

    conv: int
    start: int
    count: int = 0
    hash: int = 0
    first: list = field(default_factory=list)

    def add(self, value: int, size: int, keep: int) -> None:
        if self.count < keep:
            self.first.append((value, size))
        self.hash = (self.hash * BASE + value) % PRIME
        self.count += 1


class Walk:
    """State while conversations are rebuilt turn by turn: where in which conversation, and what later ones may borrow."""

    def __init__(self, borrowing: Borrowing):
        self.borrowing = borrowing
        self.conv: int | None = None
        self.start: int | None = None
        self.heads: list[tuple[int, int]] = []
        self.seen = self.borrowed = self.depth = self.key = 0
        self.root: int | None = None

    def begin(self, conv: int, start: int) -> None:
        """Start of a conversation; the first turns of its group's start stay at hand."""
        if conv == start or start != self.start:
            self.heads = []
        self.conv, self.start = conv, start
        self.borrowed = self.borrowing.turns(conv, start)
        self.depth = min(self.borrowed, len(self.heads))
        self.key = self.heads[self.depth - 1][0] if self.depth else 0
        self.seen, self.root = 0, None

    def advance(self, s: Stretch) -> None:
        """Take in the turns of a stretch; those that borrowed turns replace are passed over."""
        if s.conv != self.conv:
            self.begin(s.conv, s.start)
        passed = min(max(0, self.borrowed - self.seen), s.count)
        lost = 0
        for value, _ in s.first[:passed]:
            lost = (lost * BASE + value) % PRIME
        used = s.count - passed
        own = (s.hash - lost * pow(BASE, used, PRIME)) % PRIME
        if s.conv == s.start:
            for value, size in s.first:
                if len(self.heads) == self.borrowing.span - 1:
                    break
                self.heads.append((((self.heads[-1][0] if self.heads else 0) * BASE + value) % PRIME, size))
        self.key = (self.key * pow(BASE, used, PRIME) + own) % PRIME
        self.depth += used
        self.seen += s.count


def sorted_turns(rows: DataFrame, borrowing: Borrowing | None, names: tuple[str, str, str, str]) -> DataFrame:
    """(conv, start, digest, size) in the order of conversations and turns over all partitions, in reliable storage."""
    conv, turn, role, text = (F.col(n) for n in names)
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    turns = rows.filter(conv.isNotNull()).select(
        conv.cast("long").alias("conv"), turn.alias("turn"), role.alias("role"), F.octet_length(text).cast("long").alias("size"),
        F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(32))).alias("digest"),
    )
    start = F.col("conv") - F.col("conv") % borrowing.group if borrowing else F.col("conv")
    turns = turns.withColumn("start", start).withColumn("late", F.col("conv") != F.col("start"))
    # equal rows may stand in any order, so a number of their own lets a range end between them
    order = ["start", "late", "conv", "turn", "role", "digest", "n"]
    turns = turns.withColumn("n", F.monotonically_increasing_id())
    return checkpointed(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "start", "digest", "size"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        convs, starts, digests, sizes = (batch.column(i).to_pylist() for i in range(4))
        for conv, start, digest, size in zip(convs, starts, digests, sizes, strict=True):
            yield conv, start, int.from_bytes(digest, "big") % PRIME or 1, size


def summed_up(batches: Iterator[pa.RecordBatch], keep: int) -> list[Stretch]:
    """First stretch, the group start behind it that the last one may borrow from, and the last stretch."""
    lead = base = now = None
    for conv, start, value, size in _rows(batches):
        if now is None or now.conv != conv:
            if now is not None and now.conv == now.start and now is not lead:
                base = now
            now = Stretch(conv, start)
            lead = lead or now
        now.add(value, size, keep)
    if now is None:
        return []
    middle = [base] if base is not None and base.start == now.start and base is not now else []
    return [lead, *middle, *([now] if now is not lead else [])]


def carried(turns: DataFrame, borrowing: Borrowing) -> tuple[dict[int, Walk], set[int], set[int]]:
    """State before each partition, the partitions whose last conversation goes on, and the conversations that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = summed_up(batches, borrowing.span)
        if found:
            text = json.dumps([s.__dict__ for s in found])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([text])], ["part", "found"])

    states, goes_on, spanning = {}, set(), set()
    walk, before = Walk(borrowing), None
    for row in sorted(in_arrow(turns, run, "part long, found string").collect()):
        states[row.part] = deepcopy(walk)
        found = [Stretch(**s) for s in json.loads(row.found)]
        if before is not None:
            low, high = ((s, c != s, c) for s, c in ((walk.start, walk.conv), (found[0].start, found[0].conv)))
            if high < low:
                raise RuntimeError("partitions are not in the order of conversations")
            if walk.conv == found[0].conv:
                goes_on.add(before)
                spanning.add(walk.conv)
        for stretch in found:
            walk.advance(stretch)
        before = row.part
    return states, goes_on, spanning


PASSED = "key binary, parent binary, depth long, conv long, size long, root binary, member int"


def passed_nodes(
    turns: DataFrame, states: dict[int, Walk], goes_on: set[int], borrowing: Borrowing,
    crown: frozenset[bytes] = frozenset(), roots: dict[int, bytes] | None = None,
) -> DataFrame:
    """One row per conversation and depth (member 1) and one where it ends (member 0).

    With a ``crown``, root is the conversation's highest node outside it, for nodes outside it. ``roots`` names those of
    conversations that lie on several partitions.
    """
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast((states, goes_on, crown, roots or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, goes_on, crown, roots = shared.value
        part = TaskContext.get().partitionId()
        walk = deepcopy(states[part]) if part in states else Walk(borrowing)  # a worker's copy serves several tasks
        columns: list[list] = [[] for _ in range(7)]
        byte = lambda key: key.to_bytes(16, "big")
        root: bytes | None = roots.get(walk.conv)

        def put(key: int, parent: int | None, depth: int, size: int, member: int = 1) -> None:
            nonlocal root
            name = byte(key)
            inside = depth == 0 or name in crown
            if not inside and root is None:
                root = name
            values = (name, None if parent is None else byte(parent), depth, walk.conv, size, None if inside else root, member)
            for column, value in zip(columns, values, strict=True):
                column.append(value)

        def out() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PASSED.split(", ")]
            )
            for c in columns:
                c.clear()
            return made

        inside = False  # whether the walk stands in a conversation of this partition
        for conv, start, value, size in _rows(batches):
            if conv != walk.conv:
                if inside:
                    put(walk.key, None, walk.depth, 0, 0)
                walk.begin(conv, start)
                root = roots.get(conv)
                put(0, None, 0, 0)
                for d in range(walk.depth):
                    put(walk.heads[d][0], walk.heads[d - 1][0] if d else 0, d + 1, walk.heads[d][1])
            inside = True
            depth, parent = walk.depth, walk.key
            step = Stretch(conv, start)
            step.add(value, size, 1)
            walk.advance(step)
            if walk.depth > depth:
                put(walk.key, parent, walk.depth, size)
            if len(columns[0]) >= ROWS:
                yield out()
        if inside and part not in goes_on:
            put(walk.key, None, walk.depth, 0, 0)
        yield out()

    return in_arrow(turns, run, PASSED)


class SpillingQueue:
    """A priority queue of tuples whose older part lies in sorted runs on disk, each read forward once."""

    def __init__(self, held: int = HELD):
        self.held = held
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs: list = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run = tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)
        self.heap.sort()
        for a in range(0, len(self.heap), 1000):
            pickle.dump(self.heap[a : a + 1000], run)
        self.heap = []
        run.seek(0)
        self.runs.append((run, []))
        self._next(len(self.runs) - 1)

    def _next(self, at: int) -> None:
        run, block = self.runs[at]
        if not block:
            try:
                block.extend(reversed(pickle.load(run)))
            except EOFError:
                run.close()
                return
        heapq.heappush(self.heads, (block.pop(), at))

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            item, at = heapq.heappop(self.heads)
            self._next(at)
            return item
        return heapq.heappop(self.heap)


NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_ends long, size long, root binary"
TOTALS = "n_children long, n_leaves long, saved long"
SENT = ["sent_nodes", "sent_convs", "sent_leaves", "sent_saved"]


def time_forward(nodes: DataFrame) -> DataFrame:
    """Totals of the subtrees of rows ``NODE`` and ``SENT``, sorted by root and in reverse level order.

    ``SENT`` holds what came from outside the shard: children, their members, leaves and saved tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(), None
        for batch in batches:
            at = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            made: tuple[list, list, list] = ([], [], [])
            for k in range(batch.num_rows):
                if at["root"][k] != shard:
                    queue, shard = SpillingQueue(), at["root"][k]
                place = (-at["depth"][k], at["key"][k])
                children, convs, leaves, saved = (at[n][k] for n in SENT)
                while (first := queue.first()) is not None and first[:2] == place:
                    _, _, n, x, y = queue.pop()
                    children, convs, leaves, saved = children + 1, convs + n, leaves + x, saved + y
                alone = at["n_convs"][k] - at["n_ends"][k] - convs
                children, leaves = children + alone, leaves + alone
                leaves = leaves or 1
                saved += (at["n_convs"][k] - 1) * at["size"][k]
                for column, value in zip(made, (children, leaves, saved), strict=True):
                    column.append(value)
                if at["key"][k] != at["root"][k] and at["depth"][k]:
                    queue.push((1 - at["depth"][k], at["parent"][k], at["n_convs"][k], leaves, saved))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:8], *(pa.array(m, pa.int64()) for m in made)],
                [c.split()[0] for c in f"{NODE}, {TOTALS}".split(", ")],
            )

    return in_arrow(nodes, run, f"{NODE}, {TOTALS}")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv): SHA-256 of the ids in ascending order, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, length = None, None, [], 0
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if ids:
                for column, value in zip(out, (key, first, ",".join(ids)), strict=True):
                    column.append(value)

        def given() -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.string()), strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(made, ["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or length > PIECE:
                    close()
                    key, first, ids, length = k, c, [], 0
                ids.append(str(c))
                length += len(ids[-1]) + 1
            yield given()
        close()
        yield given()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    out[0].append(key)
                    out[1].append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    spread = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    cut = in_arrow(spread, pieces, "key binary, first long, ids string")
    return in_arrow(cut.repartition("key").sortWithinPartitions("key", "first"), hashed, "key binary, ends_sha256 string")


def trie(
    rows: DataFrame, borrowing: Borrowing | None = None,
    names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With a ``Borrowing``, conversations are rebuilt with turns of their group's first one before they are compared.
    """
    turns = sorted_turns(rows, borrowing, names)
    mix = borrowing or Borrowing(1, 1)
    states, goes_on, spanning = carried(turns, mix)
    seen = passed_nodes(turns, states, goes_on, mix).filter("member = 1")
    total = checkpointed(seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    all_rows = total.agg(F.sum("n")).first()[0] or 0
    crown = frozenset(bytes(r.key) for r in total.filter(F.col("n") * TOP > all_rows).select("key").collect())
    roots: dict[int, bytes] = {}
    if spanning:
        far = passed_nodes(turns, states, goes_on, mix, crown).filter(F.col("member") == 1).filter(F.col("conv").isin(list(spanning)))
        highest = far.filter("root is not null").groupBy("conv").agg(F.min_by("key", "depth").alias("key"))
        roots = {r.conv: bytes(r.key) for r in highest.collect()}
    passed = passed_nodes(turns, states, goes_on, mix, crown, roots)
    nodes = checkpointed(
        passed.groupBy("key").agg(
            F.first("parent", ignorenulls=True).alias("parent"), F.max("depth").alias("depth"),
            F.min(F.when(F.col("member") == 1, F.col("conv"))).alias("conv_id"), F.sum("member").cast("long").alias("n_convs"),
            F.sum(1 - F.col("member")).cast("long").alias("n_ends"), F.max("size").alias("size"), F.max("root").alias("root"),
        )
    )
    nothing = [F.lit(0).cast("long").alias(n) for n in SENT]
    alone = nodes.filter("n_convs = 1 and root is not null").select(
        *nodes.columns, (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")
    )
    shards = nodes.filter("n_convs > 1 and root is not null").select("*", *nothing).repartition("root")
    inner = checkpointed(time_forward(shards.sortWithinPartitions("root", F.desc("depth"), "key")))
    tops = inner.filter("key = root").groupBy("parent").agg(
        F.count(F.lit(1)).alias("sent_nodes"), F.sum("n_convs").alias("sent_convs"),
        F.sum("n_leaves").alias("sent_leaves"), F.sum("saved").alias("sent_saved"),
    )
    high = nodes.filter("root is null").join(tops.withColumnRenamed("parent", "key"), "key", "left").select(
        *nodes.columns, *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in SENT)
    )
    crowned = time_forward(high.repartition(1).sortWithinPartitions(F.desc("depth"), "key"))
    every = inner.union(alone).union(crowned)
    names_of = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "root")
    near = every.join(F.broadcast(names_of.filter("root is null").drop("root")), "parent", "left")
    known = near.filter("depth = 0 or parent_conv_id is not null")
    rest = near.filter("depth > 0 and parent_conv_id is null").drop("parent_conv_id")
    rest = rest.join(names_of.filter("root is not null").drop("root"), "parent")
    whole = known.unionByName(rest)
    digests = ends_digests(passed.filter("member = 0").select("key", "conv"))
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(digests, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
