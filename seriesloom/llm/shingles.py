"""Sets of word shingles as sorted 64-bit hashes, made for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COUNT = _RNG.integers(1, 1 << 63, WIDTH + 1, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of the text that each word belongs to.

    A-Z count as a-z; words are the runs between ``[\\x20\\x09-\\x0D]``.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - begins
    flat = raw[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(flat)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    sums = np.add.reduceat(_BYTE[flat] * powers[place], first)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    owner = np.searchsorted(offsets, begins - 1, side="right") - 1
    return mix(sums + lengths.astype(np.uint64)), owner


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer than five words has its whole sequence as one shingle; one without words has none.
    """
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    out = []
    wide = np.zeros(0, np.uint64)
    if len(words) >= WIDTH:
        wide = sum(words[k : len(words) - WIDTH + 1 + k] * _PLACE[k] for k in range(WIDTH)) + _COUNT[WIDTH]
        wide = mix(wide)
    start = 0
    for n in counts.tolist():
        if n >= WIDTH:
            out.append(np.unique(wide[start : start + n - WIDTH + 1]))
        elif n:
            out.append(mix((words[start : start + n] * _PLACE[:n]).sum(keepdims=True) + _COUNT[n : n + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out
