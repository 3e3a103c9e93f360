"""Secret scan: fixed patterns plus a token-efficiency test.

Fixed patterns find assignments, access keys and long hexadecimal runs. The test looks at every
run of identifier characters: text that a vocabulary was made for takes few tokens, a random
string many, so a run with few characters per token is reported, unless it is a known digest
(hexadecimal of a digest's length), a UUID or a decimal number. In a run that is readable as a
whole, the parts between separators are tested, alone and with their neighbours, so a path or a
name before a secret does not hide it. Spans of the fixed patterns always stay; of a random run
that overlaps one of them, what the span does not cover is reported.

Positions are code points of the whole text, the end is exclusive. Defined cases: a NULL or empty
text has no spans; NULL ids, repeated rows and extra columns pass; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.byte_bpe import load_ranks
from seriesloom.llm.common import add_columns, map_texts

# Patterns, kinds in their order, least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
METHOD = "random"
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KEYWORDS = ("passw", "secret", "token", "api")

#: Runs that the efficiency test looks at, and what it leaves out.
LEAST_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: What stands between separators in a run.
PART = re.compile(r"[A-Za-z0-9]+")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
INNER_UUID = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])", re.IGNORECASE)
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: A run of fewer characters a token than this is taken for random.
LEAST_CHARS_PER_TOKEN = 2.0

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the fixed patterns by start, then kind as listed."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def known_identifier(run: str) -> bool:
    """A digest of a usual length, a UUID or a decimal number."""
    if HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    return run.isdecimal() or UUID.fullmatch(run) is not None


class TokenCounter:
    """Tokens of a run under a vocabulary: how many, and how many bytes each has."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.coding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = {rank: len(token) for token, rank in ranks.items()}

    def __call__(self, run: str) -> int:
        return len(self.coding.encode_ordinary(run))

    def lengths(self, run: str) -> list[int]:
        return [self.size[t] for t in self.coding.encode_ordinary(run)]


def surplus(part: str, count: TokenCounter, least: float) -> float:
    """``least`` times the tokens of a part less its characters: above 0 for a random one.

    A part that is readable as a whole has the surplus of its best window of ``LEAST_RUN`` characters
    or more, if one is random. A decimal number counts for nothing.
    """
    if part.isdecimal():
        return 0.0
    lengths = count.lengths(part)
    whole = least * len(lengths) - len(part)
    if whole > 0 or len(part) < LEAST_RUN:
        return whole
    # sums[i] and ends[i]: surplus and characters of the first i tokens; low: least sum of a window's start
    sums, ends = [0.0], [0]
    best, low, at = 0.0, float("inf"), 0
    for n in lengths:
        sums.append(sums[-1] + least - n)
        ends.append(ends[-1] + n)
        while ends[-1] - ends[at] >= LEAST_RUN:
            low = min(low, sums[at])
            at += 1
        best = max(best, sums[-1] - low)
    return best if best > 0 else whole


def maximal(scores: list[float]) -> list[tuple[int, int]]:
    """First and last item of every maximal segment of positive sum (Ruzzo and Tompa), in linear time."""
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, score in enumerate(scores):
        left, total = total, total + score
        if score <= 0:
            continue
        first = i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, i, left, total, j))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, last) for first, last, *_ in kept]


def _mixed(run: str) -> bool:
    """Letters and digits, or both cases, and not a few characters repeated."""
    classes = any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run)
    return classes >= 2 and len(set(run)) >= 6


def random_parts(run: str, count: TokenCounter, least: float) -> list[tuple[int, int]]:
    """Places in a run of neighbouring parts between separators that are random together.

    Known identifiers belong to no place and separate those beside them.
    """
    known = [m.span() for m in INNER_UUID.finditer(run)]
    stretches: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(run):
        digest = len(m.group()) in DIGEST_LENGTHS and HEX_ONLY.fullmatch(m.group())
        if digest or any(a <= m.start() < b for a, b in known):
            if stretches[-1]:
                stretches.append([])
        else:
            stretches[-1].append(m.span())
    found = []
    for parts in stretches:
        for first, last in maximal([surplus(run[a:b], count, least) for a, b in parts]):
            a, b = parts[first][0], parts[last][1]
            if not PART.search(run, b):
                b = len(run)
            if b - a >= LEAST_RUN and _mixed(run[a:b]):
                found.append((a, b))
    return found


def uncovered(start: int, end: int, spans: list[Span]) -> list[tuple[int, int]]:
    """What no span (by start) covers between ``start`` and ``end``."""
    out = []
    for a, b, _ in spans:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            return out
    return [*out, (start, end)]


def method_spans(text: str, count: TokenCounter, least: float = LEAST_CHARS_PER_TOKEN, base: list[Span] | None = None) -> list[Span]:
    """Runs of low efficiency, or what is random inside a run, as far as no span of ``base`` (by start) covers it.

    A run needs letters and digits, or both cases, or it is a word of its own repeated. Runs of
    one repeated character are no secrets. A run that is random as a whole is one span unless a base
    span lies in it; else its parts between separators are scored, so that readable text beside a
    secret neither hides it nor is reported with it.
    """
    found, base, at = [], base or [], 0
    for m in RUN.finditer(text):
        run, start = m.group(), m.start()
        while at < len(base) and base[at][1] <= start:
            at += 1
        touching, i = [], at
        while i < len(base) and base[i][0] < m.end():
            if base[i][1] > start:
                touching.append(base[i])
            i += 1
        if known_identifier(run) or not _mixed(run):
            continue
        if not touching and len(run) < least * count(run):
            found.append((start, m.end(), METHOD))
            continue
        if uncovered(start, m.end(), touching):
            for a, b in random_parts(run, count, least):
                for c, d in uncovered(start + a, start + b, touching):
                    if PART.search(text, c, d):
                        found.append((c, d, METHOD))
    return found


def all_spans(text: str, count: TokenCounter, least: float = LEAST_CHARS_PER_TOKEN) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and method spans together in order."""
    base = base_spans(text)
    extra = method_spans(text, count, least, base)
    return base, sorted([*base, *extra], key=lambda s: (s[0], (*KINDS, METHOD).index(s[2])))


_COUNTERS: dict[tuple, TokenCounter] = {}


def _counter(ranks: dict[bytes, int], pattern: str) -> TokenCounter:
    key = (len(ranks), pattern)
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(ranks, pattern)
    return _COUNTERS[key]


def _rows(spark: SparkSession, of_text: Callable, ranks_path: str, pattern: str, least: float) -> Callable:
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def rows(texts: list[str]) -> list:
        count = _counter(shared.value, pattern)
        made = [of_text(t, *all_spans(t, count, least)) for t in texts]
        return [list(c) for c in zip(*made, strict=True)]

    return rows


def find_secrets(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST_CHARS_PER_TOKEN,
) -> DataFrame:
    """One row per document: secrets, an array of (kind, start, end, value)."""

    def of_text(text, base, spans):
        return ([{"kind": k, "start": a, "end": b, "value": text[a:b]} for a, b, k in spans],)

    kind = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    rows = _rows(docs.sparkSession, of_text, ranks_path, pattern, least)
    return map_texts(docs, f"secrets {kind}", rows, id_col, text_col)


def span_digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts per fixed kind, SHA-256 of the base spans and all spans as text."""

    def of_text(text, base, spans):
        kinds = [s[2] for s in base]
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        digest = hashlib.sha256(listed.encode()).hexdigest()
        return (*(kinds.count(k) for k in KINDS), digest, ",".join(f"{k}:{a}:{b}" for a, b, k in spans))

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    rows = _rows(docs.sparkSession, of_text, ranks_path, pattern, LEAST_CHARS_PER_TOKEN)
    return map_texts(docs, schema, rows, id_col, text_col)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; NULL stays NULL."""
    rows = _rows(docs.sparkSession, lambda t, b, spans: (masked(t, spans),), ranks_path, pattern, LEAST_CHARS_PER_TOKEN)
    made = add_columns(docs, "_masked string", rows, text_col)
    text = F.when(F.col(text_col).isNotNull(), F.col("_masked"))
    return made.withColumn(text_col, text).drop("_masked")
