"""Fuzzy search for short licence notices.

A notice of length L that may differ by k edits is cut into k + 1 pieces; by the pigeonhole
principle one piece stands unchanged in every occurrence. The pieces of all notices are found
in one Aho-Corasick pass; around each, the regex library matches the notice with a bounded number of
edits, which verifies the place and gives its span. Words are compared in lower case and joined by
single spaces, so layout does not count as an edit. Notices with k = 0 are the base phrases.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; positions are counted in
words from 0. Defined cases: a NULL or empty text has no words and no hits; NULL ids, repeated
rows and extra columns pass; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from seriesloom.llm.common import map_texts

# Words, base phrases and their labels.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices that the search adds, with the share of their characters that may be edited.
NOTICES = (
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mozilla public license version 2 0", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("released under the mit license", "mit"),
    ("creative commons attribution", "cc-by"),
    ("this work is licensed under cc by", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
)
EDIT_SHARE = 0.12

#: Lower-cases A-Z; of UTF-8 bytes also turns all that is no part of a word into spaces.
LOWER = {c: c + 32 for c in range(65, 91)}
WORDS_ONLY = bytes(LOWER.get(b, b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32) for b in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    base: bool

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """k + 1 pieces of nearly equal length, with their offsets."""
        n, k = len(self.phrase), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Hit:
    label: str
    base: bool
    edits: int
    first_word: int
    end_word: int
    start: int
    end: int
    similarity: float


@cache
def notices(base: tuple = BASE, more: tuple = NOTICES, share: float = EDIT_SHARE) -> tuple[Notice, ...]:
    exact = [Notice(p, label, 0, True) for p, label in base]
    return (*exact, *(Notice(p, label, int(len(p) * share), False) for p, label in more))


class Scanner:
    def __init__(self, wanted: tuple[Notice, ...]):
        self.notices = wanted
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(wanted):
            for offset, piece in notice.pieces:
                places.setdefault(piece, []).append((i, offset))
        for piece, at in places.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()
        self.fuzzy = [
            regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?![^ ])") for n in wanted
        ]

    def scan(self, text: str) -> tuple[int, list[Hit]]:
        """Number of words, and every place of a notice by notice and place; spans are those of ``text``."""
        words = text.encode("utf-8", "surrogatepass").translate(WORDS_ONLY).split()
        joined = b" ".join(words).decode("utf-8", "surrogatepass")
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, at) in self.seeds.iter(joined):
            for i, offset in at:
                start = last + 1 - length - offset
                k = self.notices[i].edits
                windows.setdefault(i, []).append((start - k, start + len(self.notices[i].phrase) + k))
        found = [(i, *v) for i, wanted in sorted(windows.items()) for v in sorted(self._verified(i, wanted, joined))]
        if not found:
            return len(words), []
        spans = [m.span() for m in WORD.finditer(text.translate(LOWER))]
        starts = np.cumsum([0] + [b - a + 1 for a, b in spans]).tolist()
        hits = []
        for i, start, end, edits in found:
            first = bisect_right(starts, start) - 1
            last = bisect_right(starts, end - 1) - 1
            n = self.notices[i]
            hits.append(
                Hit(n.label, n.base, edits, first, last + 1, spans[first][0], spans[last][1], 1 - edits / len(n.phrase))
            )
        return len(words), hits

    def _verified(self, i: int, wanted: list[tuple[int, int]], joined: str) -> set[tuple[int, int, int]]:
        """Spans and edits of notice ``i``: the best match of every window and what lies beside it there; of
        places that overlap, those with the fewest edits."""
        notice, found = self.notices[i], set()
        if not notice.edits:
            for a, b in wanted:
                if (a == 0 or joined[a - 1] == " ") and (b == len(joined) or joined[b : b + 1] == " "):
                    found.add((a, b, 0))
            return found
        places = set()
        for a, b in set(wanted):
            lo, hi = max(0, a), min(len(joined), b)
            if joined[hi : hi + 1] not in ("", " "):
                hi = joined.rfind(" ", lo, hi)  # the end of a window must not pass for that of a word
            stretches = [(lo, hi)]
            while stretches:
                lo, hi = stretches.pop()
                m = self.fuzzy[i].search(joined, lo, hi) if hi - lo >= len(notice.phrase) - notice.edits else None
                if m and m.end() > m.start():
                    places.add((sum(m.fuzzy_counts), *m.span()))
                    stretches += [(lo, m.start() - 1), (m.end() + 1, hi)]
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(places):
            at = bisect_right(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                found.add((a, b, edits))
        return found


@cache
def scanner(wanted: tuple[Notice, ...]) -> Scanner:
    return Scanner(wanted)


def find_notices(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: tuple[Notice, ...] | None = None
) -> DataFrame:
    """One row per document: hits, an array of label, base, edits, words, code-point span and similarity."""
    wanted = wanted or notices()

    def rows(texts: list[str]) -> list:
        scan = scanner(wanted).scan
        return [[[vars(h) for h in scan(t)[1]] for t in texts]]

    kind = "array<struct<label:string,base:boolean,edits:bigint,first_word:bigint,end_word:bigint,start:bigint,end:bigint,similarity:double>>"
    return map_texts(docs, f"hits {kind}", rows, id_col, text_col)


def notice_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word count, base places and labels, all labels and the best similarity of each document."""
    wanted = notices()

    def of_text(text: str) -> tuple:
        n_words, hits = scanner(wanted).scan(text)
        base = [h for h in hits if h.base]
        at = [h.first_word for h in base]
        return (
            n_words, len(base), min(at, default=None), max(at, default=None),
            ",".join(sorted({h.label for h in base})), ",".join(sorted({h.label for h in hits})),
            max((h.similarity for h in hits), default=0.0),
        )

    def rows(texts: list[str]) -> list:
        return [list(c) for c in zip(*map(of_text, texts), strict=True)]

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, schema, rows, id_col, text_col)
