"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token with one probe.
Tier 2: any other pre-token becomes a linked list of bytes whose adjacent pairs wait in a heap
by rank; the lowest rank, leftmost first, is merged until no pair is in the vocabulary.

Text between single spaces is a safe unit of work (see ``Encoder.encode``), so each task keeps a
bounded memo of such units. Tables built from the rank file are broadcast; their size is that of
the vocabulary, whatever the input.

Defined cases: NULL and empty texts encode to no ids and decode to no bytes; NULL ids, repeated
rows and extra columns pass through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from seriesloom.llm.common import map_texts

#: Entries of one generation of the memo; two generations are kept.
MEMO_ENTRIES = 600_000
#: Bytes of one generation, and the longest part that is kept: where words have no spaces, a part is a paragraph.
MEMO_BYTES, MEMO_PART = 128 << 20, 64
#: Bytes of an entry beside its text and ids: two objects and a place in the table.
ENTRY_BYTES = 200

#: A space with white space before it, and white space or the end behind it.
IRREGULAR = re.compile(r"\s (?:\s|\Z)")


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Constants of the second hash, which depends on the displacement.
GOLDEN, ODD, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys take the slots 0..n-1.

    Keys fall into buckets of about four; from the largest bucket down, a displacement is
    searched that sends all its keys to free slots. Buckets of one key take a free slot
    outright, stored as a negative number. A probe compares the key, so others are refused.
    If a bucket finds no displacement, all starts anew under another seed.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 4) | 1
        self.seed = 0
        while (slots := self._place(keys)) is None:
            self.seed += 1
        self.keys: list[bytes] = [b""] * self.n
        self.values = array("q", [-1]) * self.n
        for slot, key, value in zip(slots, keys, values, strict=True):
            self.keys[slot], self.values[slot] = key, value

    def _place(self, keys: list[bytes]) -> list[int] | None:
        hashes = [xxhash.xxh3_64_intdigest(k, self.seed) for k in keys]
        known = np.array(hashes, np.uint64)
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 13) % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        free = np.ones(self.n, bool)
        slots = [0] * len(keys)
        tries = np.arange(1, 257, dtype=np.uint64)[:, None]
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                break
            for start in range(0, 1 << 20, 256):
                d = tries + np.uint64(start)
                mixed = (known[members][None, :] ^ (d * np.uint64(GOLDEN))) * np.uint64(ODD)
                at = ((mixed >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)
                good = free[at].all(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    break
            else:
                return None
            row = int(good.argmax())
            self.shift[bucket] = int(d[row, 0])
            free[at[row]] = False
            for i, slot in zip(members, at[row].tolist(), strict=True):
                slots[i] = slot
        rest = iter(np.flatnonzero(free).tolist())
        for bucket, members in groups.items():
            if len(members) == 1:
                slots[members[0]] = next(rest)
                self.shift[bucket] = -slots[members[0]] - 1
        return slots

    def get(self, key: bytes) -> int:
        """The value of ``key``, or -1."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[(h >> 13) % self.buckets]
        slot = -d - 1 if d < 0 else ((h ^ (d * GOLDEN & WORD)) * ODD & WORD) >> 20
        slot %= self.n
        return self.values[slot] if self.keys[slot] == key else -1


class Encoder:
    """Encodes and decodes texts by a rank table; ``pattern`` splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = MEMO_ENTRIES, memo_bytes: int = MEMO_BYTES):
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        #: rank of a merge by left id * 2**32 + right id, for every way to cut a token into two tokens
        self.pairs = {
            (ranks[token[:i]] << 32) | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        #: the same for two bytes, by left byte * 256 + right byte; -1 if they don't merge
        self.two = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.memo_entries, self.memo_bytes, self.held = memo_entries, memo_bytes, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token outside the vocabulary: a heap of ranked pairs over linked bytes.

        ``ranks[i]`` is the rank of the pair that starts at ``i``; an entry of the heap counts only
        while it agrees with it.
        """
        n = len(token)
        pairs = self.pairs.get
        ids = [self.byte_ids[b] for b in token]
        ranks = [self.two[a << 8 | b] for a, b in zip(token, token[1:])]
        ranks.append(-1)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        while heap:
            item = heappop(heap)
            i = item & 0xFFFFFFFF
            rank = item >> 32
            if ranks[i] != rank:
                continue
            ids[i] = rank
            j = right[i]
            ids[j] = ranks[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                ranks[i] = found = pairs(rank << 32 | ids[k], -1)
                if found >= 0:
                    heappush(heap, found << 32 | i)
            else:
                ranks[i] = -1
            h = left[i]
            if h >= 0:
                ranks[h] = found = pairs(ids[h] << 32 | rank, -1)
                if found >= 0:
                    heappush(heap, found << 32 | h)
        return [x for x in ids if x >= 0]

    def pretoken(self, token: bytes) -> list[int]:
        rank = self.whole.get(token)
        return [rank] if rank >= 0 else self.merge(token)

    def unit(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for piece in self.split(text):
            ids += self.pretoken(piece.encode())
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as bytes.

        A match of the pattern never runs from before a space into what follows it, unless the
        space stands inside a run of white space; so the text may be cut before each space and
        the parts encoded one by one. Texts with a space inside such a run go whole. The memo is
        keyed by the part without its space, which every part but the first has.
        """
        if IRREGULAR.search(text):
            return self.unit(text)
        first, *rest = text.split(" ")
        parts = [self.unit(first)]
        young = self.young
        for part in rest:
            found = young.get(part)
            if found is None:
                found = self.old.get(part) or self.unit(" " + part)
                if len(part) <= MEMO_PART:
                    if len(young) >= self.memo_entries or self.held >= self.memo_bytes:
                        self.old, self.young, self.held = young, {}, 0
                        young = self.young
                    young[part] = found
                    self.held += ENTRY_BYTES + 4 * len(part) + len(found)
            parts.append(found)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The encoder of this process for a rank table, built once."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes)."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, digests=False)


def encode_digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As ``encode_texts``, with the SHA-256 of ids and of decoded bytes in their place."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, digests=True)


def _encoded(docs, ranks_path, pattern, id_col, text_col, digests):
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    kept = (lambda b: hashlib.sha256(b).hexdigest()) if digests else bytes

    def rows(texts: list[str]) -> list:
        encoder = encoder_of(shared.value, pattern)
        ids = [encoder.encode(t) for t in texts]
        return [[len(x) // 4 for x in ids], [kept(x) for x in ids], [kept(encoder.decode(x)) for x in ids]]

    kind = "string" if digests else "binary"
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return map_texts(docs, f"n_tokens long, {names[0]} {kind}, {names[1]} {kind}", rows, id_col, text_col)
