"""Alignment of two tokenizers over a corpus: which tokens of one cover the same bytes as tokens of the other.

A byte-level vocabulary (A) encodes a space and the text, a piece vocabulary (B) the text, before which it puts a
space itself. Where tokens of both end at the same byte, the text is cut into groups; every token of A in a group is
linked with every token of B in it. A pair's count is the number of documents that hold it linked.

Each distinct text is encoded once: documents are grouped by their full text first, with their number of copies,
and pair counts are weighted by it. The pairs of a text are written to the shared folder, so both later passes
read them instead of encoding again. Pair counts add up in every task before the shuffle.

Looking the counts up again would move every pair of every text, and common pairs would be hot keys. Pairs that hold more
than one ``SHARE``-th of all (text, pair) rows are at most ``SHARE`` in number, whatever the corpus; they are
broadcast. The others, none of which is hot, are joined by a shuffle. Documents get the measures of their text in
the same manner: texts with more than one ``HOT_TEXTS``-th of all documents by broadcast, the others by a shuffle,
both by the SHA-256 digest of the text.

Long texts are cut where one space stands between two characters that are none; no token of either vocabulary
crosses such a place (``Encoders`` checks that for B), so the tokens are those of the whole text, and memory is
that of one slice. A text without such places is encoded whole.

Defined cases: texts that are NULL, empty or not given back by the joined tokens have no tokens and zeros, with '' as
digest; rows with a NULL id and repeated rows are documents like others; ties for an id's highest count are all best;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import in_arrow, slices, texts_of
from seriesloom.session import scratch_path

#: Most pairs, and most texts, that are broadcast.
SHARE, HOT_TEXTS = 1 << 18, 10_000
#: Characters of a text from which on it is encoded in parts, and of such a part.
LONG, PART = 1 << 19, 1 << 18
#: Link rows that a task holds before it hands on their sums.
HELD = 1 << 20
#: Distinct tokens of both sides up to which a group's pairs are laid out at once.
SMALL = 64
#: A pair (a, b) is the number a * WIDTH + b.
WIDTH = 1 << 20

# Fixed value: how a byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts below this character are merged by ``tiktoken``: it gives the same ids several times faster, and both libraries
#: agree on which of these characters are letters, numbers and spaces.
EARLY = "\u0530"

_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others, in order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letter = byte_of_letter()
        with open(byte_level, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letter[c] for c in token)
        self.fast = self._merged_by_rank(described)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8", "surrogatepass")
            for i, p in enumerate(names)
        ]
        self.divisible = not any(re.search("[^▁]▁", p) for p in names)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        as_objects = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_comma, self.a_bar = (as_objects(len(self.a_bytes), e) for e in ",|")
        self.b_comma, self.b_semi = (as_objects(len(self.b_bytes), e) for e in ",;")

    def _merged_by_rank(self, described: dict) -> object | None:
        """The same vocabulary in ``tiktoken``, if its ids are in the order of its merges and it splits as ``SPLIT`` does."""
        model, before = described["model"], described["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        if described["normalizer"] or not plain or model.get("ignore_merges") or len(model["vocab"]) != 256 + len(model["merges"]):
            return None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        if any(model["vocab"].get("".join(pair)) != 256 + i for i, pair in enumerate(pairs)):
            return None
        import tiktoken

        ranks = {token: i for i, token in enumerate(self.a_bytes)}
        return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        early = [self.fast is not None and max(t) < EARLY for t in texts]
        late = iter(self.a.encode_batch_fast([t for t, e in zip(texts, early, strict=True) if not e], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if e else next(late).ids for t, e in zip(texts, early, strict=True)]

    def parts(self, text: str) -> list[str]:
        """``text`` cut before single spaces into parts of about ``PART`` characters; each later part lacks its space."""
        if len(text) < LONG or not self.divisible:
            return [text]
        out, start = [], 0
        while start < len(text):
            found = _CUT.search(text, start + PART)
            end = found.start() if found else len(text)
            out.append(text[start:end])
            start = end + 1
        return out

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids of A and B for each text."""
        parts = [self.parts(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        a = self.a_ids([" " + p for p in flat])
        b = self.b.encode(flat, out_type=int, num_threads=1)
        out, at = [], 0
        for ps in parts:
            n = len(ps)
            out.append(tuple(np.concatenate([np.array(x, np.int64) for x in side[at : at + n]]) for side in (a, b)))
            at += n
        return out

    def aligned(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        want = b" " + text.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want == b"".join(map(self.b_bytes.__getitem__, b.tolist()))


@cache
def encoders(byte_level: str, pieces: str) -> Encoders:
    """One pair of tokenizers per worker."""
    return Encoders(byte_level, pieces)


def groups(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group number of every token of both sides, and the number of groups."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    both = np.intersect1d(a_end, b_end, assume_unique=False)
    return np.searchsorted(both, a_end), np.searchsorted(both, b_end), len(both)


def links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pair numbers of a text and how many links each has.

    Small groups are laid out token by token, larger ones by their distinct tokens.
    """
    n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    small = n_a * n_b <= SMALL
    keep = small[in_a]
    reps = n_b[in_a[keep]]
    left = np.repeat(a[keep], reps)
    first_b = np.cumsum(n_b) - n_b
    inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    right = b[np.repeat(first_b[in_a[keep]], reps) + inner]
    codes, times = [left * WIDTH + right], [np.ones(len(left), np.int64)]
    first_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(~small):
        x, x_n = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, y_n = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        codes.append((x[:, None] * WIDTH + y).ravel())
        times.append((x_n[:, None] * y_n).ravel())
    every, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, place, np.concatenate(times))
    return every, total


def digest(e: Encoders, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n: int) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
    n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    words = np.empty(len(a) + len(b), object)
    at_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[in_a]
    at_b = np.arange(len(b)) + np.cumsum(n_a)[in_b]
    words[at_a], words[at_b] = e.a_comma[a], e.b_comma[b]
    last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
    words[at_a[last_a]], words[at_b[last_b]] = e.a_bar[a[last_a]], e.b_semi[b[last_b]]
    return hashlib.sha256("".join(words.tolist())[:-1].encode()).hexdigest()


PAIRED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align_texts(texts: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Rows (text, copies, key) of distinct texts as ``PAIRED``: sizes, digest, distinct pairs and their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(byte_level, pieces)
        for batch in batches:
            for s, t in slices(batch.column(0), 1 << 20):
                part = batch.slice(s, t - s)
                made: list[list] = [[] for _ in range(7)]
                values = texts_of(part.column(0))
                for text, (a, b) in zip(values, e.ids(values), strict=True):
                    row = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                    if text and e.aligned(text, a, b):
                        in_a, in_b, n = groups(e.a_size[a], e.b_size[b])
                        codes, times = links(a, b, in_a, in_b, n)
                        row = (len(a), len(b), n, int(times.sum()), digest(e, a, b, in_a, in_b, n), codes, times)
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
                arrays = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
                names = [c.split()[0] for c in PAIRED.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), *arrays], names)

    return in_arrow(texts.select("text", "copies", "key"), run, PAIRED)


def pair_counts(paired: DataFrame) -> DataFrame:
    """(pair, n, rows): documents and texts that hold each pair; sums are formed in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            pairs, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums = []
            for k in (1, 2):
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, place, np.concatenate([h[k] for h in held]))
                sums.append(total)
            return pairs, *sums

        def batch_of(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["pair", "n", "rows"])

        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            held.append((flat, np.repeat(batch.column(0).to_numpy(), sizes), np.ones(len(flat), np.int64)))
            size += len(flat)
            if size > HELD:
                held[:] = [out()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch_of(held.pop())
                    size = 0
        if held:
            yield batch_of(out())

    rows = in_arrow(paired.select("copies", "pairs"), run, "pair long, n long, rows long")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def _with_counts(paired: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of every text. ``counts`` has (pair, n, rows, best)."""
    spark = paired.sparkSession
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") * SHARE > total
    common = counts.filter(hot).orderBy("pair").select("pair", "n", "best").toArrow()
    table = spark.sparkContext.broadcast(tuple(common.column(i).to_numpy() for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            sums, tops = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(pairs):
                np.add.at(sums, owner[known], (n[at] * times)[known])
                np.add.at(tops, owner[known], (best[at] * times)[known])
            rest = ~known
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[rest], minlength=batch.num_rows))])
            left = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[rest], pa.int64())) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tops), pa.array(sums), *left], ["key", "n_best", "count_sum", "pairs", "times"]
            )

    made = "key binary, n_best long, count_sum long, pairs array<long>, times array<long>"
    found = in_arrow(paired.select("key", "pairs", "times"), run, made)
    rare = found.filter(F.size("pairs") > 0).select("key", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    looked = rare.join(counts.filter(~hot), "pair").groupBy("key").agg(
        F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    both = found.select("key", "n_best", "count_sum").union(looked.select("key", "n_best", "count_sum"))
    return both.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest_of = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    paired = _written(align_texts(texts.withColumn("key", digest_of), byte_level, pieces), "pairs")
    counts = _written(pair_counts(paired), "counts")
    side = F.expr(f"pair div {WIDTH}")
    highest = counts.groupBy(side.alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", side).join(highest, "a").select("pair", "n", "rows", (F.col("n") == F.col("most")).cast("long").alias("best"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    sizes = paired.select("key", "copies", *names[:4], names[-1])
    measures = _written(sizes.join(_with_counts(paired, counts), "key").select("key", "copies", *names), "measures")
    total = measures.agg(F.sum("copies")).first()[0] or 0
    hot = measures.filter(F.col("copies") * HOT_TEXTS > total)
    rest = measures.filter(F.col("copies") * HOT_TEXTS <= total)
    keyed = rows.select("id", F.when(F.col("text") != "", digest_of).alias("key"))
    first = keyed.join(F.broadcast(hot.withColumnRenamed("key", "_key")), F.col("key") == F.col("_key"), "left")
    at_once = first.filter("_key is not null or key is null")
    later = first.filter("_key is null and key is not null").select("id", "key").join(rest, "key")
    zero = [F.coalesce(n, F.lit("") if n == "groups_sha256" else F.lit(0).cast("long")).alias(n) for n in names]
    return at_once.select("id", *names).union(later.select("id", *names)).select(F.col("id").alias(id_col), *zero)
