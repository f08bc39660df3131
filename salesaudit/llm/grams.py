"""Arrays of character n-grams and of word hashes for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTERS = 21  # bits of a code point

# Odd constants of a multiplicative mixing of 64-bit numbers (fixed values).
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text, each run of other characters as one 0, with 0 at both ends."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    codes = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    repeated = (codes[1:] == 0) & (codes[:-1] == 0)
    return codes[np.concatenate(([True], ~repeated))]


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in zip((30, 27), MULTIPLIERS, strict=True):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def _series(factor: int, length: int) -> np.ndarray:
    factors = np.full(length + 1, factor, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


@lru_cache(maxsize=4)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse among 64-bit numbers."""
    return _series(BASE, length), _series(pow(BASE, -1, 1 << 64), length)


@lru_cache(maxsize=1)
def _blanks() -> np.ndarray:
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return blank


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text with A-Z in lower case, starts and ends of its words.

    A word is a run of bytes other than space and the controls 9 to 13.
    """
    return _spans(text.encode("utf-8", "replace").lower())


def _spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate(([False], ~_blanks()[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    return _hashed(*word_spans(text))


def hashes_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of texts one after another, and where the words of each begin and the last end among them."""
    parts = [text.encode("utf-8", "replace") for text in texts]
    data, starts, ends = _spans(b"\n".join(parts).lower())
    begins = np.cumsum([0, *(len(part) + 1 for part in parts)])
    return _hashed(data, starts, ends), np.searchsorted(starts, begins)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _powers(1 << int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * inverses[starts]
    return mixed(values ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of words from a start to its end."""
    powers, inverses = _powers(1 << int(len(words) + 1).bit_length())
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, sorted, each once.

    Fewer words count as one run; no words give no shingle.
    """
    if not len(words):
        return words
    return np.unique(rolled(words, min(width, len(words))))


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, in order."""
    size = len(words) - width + 1
    if size < 1:
        return np.zeros(0, dtype=np.uint64)
    total = words[:size].copy()
    for i in range(1, width):
        total = mixed(total * np.uint64(BASE) + np.uint64(i)) + words[i : i + size]
    return mixed(total + np.uint64(width))


def blocks(lengths: np.ndarray, most: int, items: int) -> Iterator[slice]:
    """Slices of consecutive items of at most ``items`` items and, but for a single one, ``most`` in total length."""
    start, total = 0, 0
    for i, length in enumerate(lengths):
        if i > start and (total + length > most or i - start >= items):
            yield slice(start, i)
            start, total = i, 0
        total += int(length)
    if start < len(lengths):
        yield slice(start, len(lengths))
