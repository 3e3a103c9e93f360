"""Toxicity score from a weighted lexicon.

Texts are folded first: lower case, format characters dropped, homoglyphs and Latin letters with
diacritics to plain letters, digits and signs that stand for letters to those letters, everything
else to single spaces. One Aho-Corasick pass then finds the
entries of the lexicon, whole words or word beginnings, and the exception phrases; an entry
inside an exception phrase does not count. The weights of the rest, as a sum and per word of the
text, go through a logistic curve.

Weights are log odds learned from labelled rows: each word and word beginning is counted by
documents of either class, near copies counting once (``_copy_key``). Entries need a least support
and least odds; a short list of known insults is always there. One part of the sample gives the
lexicon, the other the curve. The sample is bounded (``labelled.SAMPLE_ROWS``), as is the lexicon
(``LEXICON_ENTRIES``); scoring is one pass over all documents without a shuffle.

Defined cases: NULL and empty texts have no matches and get the score of a text without any;
without labels of both classes a fixed curve is used; NULL ids, repeated rows and extra columns
pass; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import add_columns, in_arrow, map_texts, texts_of
from seriesloom.llm.labelled import SAMPLE_ROWS, labelled_texts, training_sample

#: Known insults with their weight before learning, and phrases in which such words are harmless.
KNOWN = {w: 4.0 for w in ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "imbecile")}
EXCEPTIONS = (
    "idiot proof", "idiot board", "clown fish", "class clown", "trash can", "trash bin", "trash bag", "pond scum",
    "soap scum", "pathetic fallacy", "loser bracket", "sore loser", "stupid mistake",
)

#: Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвгдеёзијкмнорстухѕіјһԁԛԝɑαβεικνορτυχıⅼ", "abbrdeeeujkmhopctyxsijhdqwaabeiknoptuxil", strict=False))
SIGNS = dict(zip("013457@$", "oieastas", strict=True))
#: Latin letters with diacritics, also those that Unicode does not decompose, and small capitals.
_NAMED = re.compile("LATIN (?:SMALL LETTER (?:DOTLESS )?([A-Z])(?: WITH .+)?|LETTER SMALL CAPITAL ([A-Z]))")
_LATIN = (range(0x80, 0x2B0), range(0x1D00, 0x1DC0), range(0x1E00, 0x1F00), range(0x2C60, 0x2C80), range(0xA720, 0xA800), range(0xAB30, 0xAB70))
_FOLD = {c: (m[1] or m[2]).lower() for r in _LATIN for c in r if (m := _NAMED.fullmatch(unicodedata.name(chr(c), "")))}
_FOLD |= {ord("æ"): "ae", ord("œ"): "oe", ord("ß"): "ss"} | {ord(k): v for k, v in HOMOGLYPHS.items()}
#: Characters that are not seen, what is no part of a word, and marks on folded letters or on nothing.
_UNSEEN = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]")
_APART = regex.compile(r"[^\p{L}\p{N}\p{M}\x00-\x7F]")
_MARKS = regex.compile(r"(?<![^a-z0-9@$ ])\p{M}+")


class _Folding(dict):
    """What stands for each code point, made when one is first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if _UNSEEN.match(char):
            out = ""
        elif _APART.match(char):
            out = " "
        else:
            out = unicodedata.normalize("NFD", char.lower().translate(_FOLD)).translate(_FOLD)
        self[code] = out
        return out


_FOLDING = _Folding()
_BYTES = bytes(
    b + 32 if 65 <= b < 91 else ord(SIGNS[chr(b)]) if chr(b) in SIGNS else b if b >= 128 or 97 <= b < 123 else 32
    for b in range(256)
)

STEMS = (4, 5, 6)
LEAST_SUPPORT, LEAST_ODDS, LEXICON_ENTRIES = 6, 3.0, 5_000
#: Terms a task holds before it hands its counts on.
HELD_TERMS = 200_000


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLDING)
        if not text.isascii():
            text = unicodedata.normalize("NFC", _MARKS.sub("", text))
    raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    return raw.decode("utf-8", "surrogatepass").lower().split()


def _variants(word: str) -> set[str]:
    """A 1 is folded to i but may stand for l."""
    return {word, word.replace("l", "i")}


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: intercept, weight per log of the sum, weight per log of the sum per 100 words
    curve: tuple[float, float, float] = (-4.0, 1.5, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        """Values are (length, weight); exceptions have no weight."""
        entries: dict[str, tuple[int, float | None]] = {}
        for words, end in ((self.stems, ""), (self.words, " ")):
            for word, weight in words.items():
                for form in _variants(word):
                    entries[f" {form}{end}"] = (len(form), weight)
        for phrase in self.exceptions:
            folded = " ".join(fold(phrase))
            entries[f" {folded} "] = (len(folded), None)
        out = ahocorasick.Automaton()
        for key, value in entries.items():
            out.add_word(key, (key.endswith(" "), *value))
        out.make_automaton()
        return out


def matched(text: str, automaton: ahocorasick.Automaton) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Weight of all matches, words of the text, and matches (start, end, weight) in the folded text.

    At one place the heaviest entry counts.
    """
    words = fold(text)
    joined = f" {' '.join(words)} "
    best: dict[int, tuple[int, float]] = {}
    harmless = []
    for last, (closed, length, weight) in automaton.iter(joined):
        end = last if closed else last + 1
        start = end - length
        if weight is None:
            harmless.append((start, end))
        elif start not in best or best[start][1] < weight:
            best[start] = (end, weight)
    hits = _outside(best, sorted(harmless))
    return sum(w for _, _, w in hits), len(words), hits


def _outside(best: dict[int, tuple[int, float]], harmless: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Matches that lie in no exception phrase, in order of place; both lists are walked once."""
    hits, at, reach = [], 0, -1
    for start, (end, weight) in sorted(best.items()):
        while at < len(harmless) and harmless[at][0] <= start:
            reach = max(reach, harmless[at][1])
            at += 1
        if end > reach:
            hits.append((start, end, weight))
    return hits


def _inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (words + 20))], axis=1)


def _copy_key(words: list[str]) -> int:
    """Smallest hash of three words in a row: mostly equal for near copies."""
    if len(words) < 3:
        return xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh3_64_intdigest(f"{a} {b} {c}") for a, b, c in zip(words, words[1:], words[2:])) >> 1


def _terms(words: set[str]) -> set[str]:
    whole = {f"{w} " for w in words if 3 <= len(w) <= 30}
    return whole | {w[:k] for w in words for k in STEMS if len(w) > k}


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic", bound: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon and its curve from at most ``bound`` labelled rows that ``allowed`` (on ``labels``) admits."""
    texts = labelled_texts(docs, training_sample(labels, label_col, allowed, bound))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [fold(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_copy_key(w) for w in words], pa.int64()), batch.column(2), pa.array([" ".join(w) for w in words])],
                ["copy", "label", "text"],
            )

    once = in_arrow(texts, folded, "copy long, label int, text string").groupBy("copy").agg(
        F.max(F.struct("label", "text")).alias("r")
    )
    once = once.select("copy", "r.label", "r.text").persist()
    try:
        lexicon = _weights(once.filter("copy % 3 <> 0"))
        return Lexicon(lexicon.words, lexicon.stems, curve=_curve(once.filter("copy % 3 = 0"), lexicon))
    finally:
        once.unpersist()


def _weights(once: DataFrame) -> Lexicon:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out():
            terms = list(held[0].keys() | held[1].keys())
            arrays = [terms, [held[0][t] for t in terms], [held[1][t] for t in terms]]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.string()), *(pa.array(a, pa.int64()) for a in arrays[1:])], ["term", "clean", "toxic"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[label].update(_terms(set(text.split(" "))))
                if len(held[0]) + len(held[1]) > HELD_TERMS:
                    yield out()
        yield out()

    by_class = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    clean, toxic = by_class.get(0, 0), by_class.get(1, 0)
    words = dict(KNOWN)
    if not clean or not toxic:
        return Lexicon(words)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    top = (
        in_arrow(once.select("label", "text"), counted, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= LEAST_SUPPORT)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("toxic"), "term")
        .limit(LEXICON_ENTRIES)
        .collect()
    )
    stems = {}
    for r in top:
        (words if r.term.endswith(" ") else stems)[r.term.strip()] = r.odds
    return Lexicon(words, stems)


def _curve(once: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression by Newton steps on rows that did not make the lexicon."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            made = [matched(t, automaton)[:2] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(w) for w, _ in made], pa.float64()), pa.array([n for _, n in made], pa.int64())],
                ["label", "weight", "words"],
            )

    rows = in_arrow(once.select("label", "text"), weighed, "label int, weight double, words long").collect()
    y = np.array([r.label for r in rows], float)
    if len(np.unique(y)) < 2:
        return Lexicon().curve
    x = _inputs(np.array([r.weight for r in rows]), np.array([r.words for r in rows], float))
    beta, ridge = np.zeros(3), np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def score(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None
) -> DataFrame:
    """One row per document: score between 0 and 1, and the number of matches that count.

    With ``keep``, all columns and the score under that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    made: dict[str, ahocorasick.Automaton] = {}

    def rows(texts: list[str]) -> list:
        if not made:
            made["it"] = shared.value.automaton()
        automaton = made["it"]
        got = [matched(t, automaton) for t in texts]
        x = _inputs(np.array([w for w, _, _ in got], float), np.array([n for _, n, _ in got], float))
        scores = 1 / (1 + np.exp(-np.clip(x @ np.array(shared.value.curve), -35, 35)))
        return [scores, [len(h) for _, _, h in got]]

    if keep:
        return add_columns(docs, f"{keep} double", lambda texts: rows(texts)[:1], text_col)
    return map_texts(docs, "score double, n_matches long", rows, id_col, text_col)
