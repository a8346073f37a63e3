"""Hashes of word shingles, shared by the near-duplicate operators.

A word is a run of letters, digits and underscores; each letter counts as its lower case. Whole batches
of texts are cut and hashed at once: a table has a 64-bit digit for each letter, a word's hash is the
polynomial of its digits, a shingle's hash that of its words.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

N = 5
WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Code points that are handled at once, more only for a longer word.
PIECE = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _digits() -> np.ndarray:
    """For each code point the digit of its lower case, 0 where it is no part of a word."""
    lower = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum() or ch == "_":
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return np.where(lower > 0, mixed(lower * _P) | np.uint64(1), np.uint64(0))


@cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P)
    out[0] = 1
    return np.multiply.accumulate(out)


def _pieces(code: np.ndarray, digit: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of about PIECE code points that end where no word does."""
    out, at = [], 0
    while at < len(code):
        end = min(at + PIECE, len(code))
        while end < len(code):
            back = np.flatnonzero(digit[code[max(at, end - 4096) : end]] == 0)
            if len(back):
                end = max(at, end - 4096) + int(back[-1]) + 1
                break
            end = min(end + 4096, len(code))
        out.append((at, end))
        at = end
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, in order; how many of them each text has)."""
    digit = _digits()
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.cumsum([len(t) + 1 for t in texts])
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in _pieces(code, digit):
        d = digit[code[lo:hi]]
        inside = np.flatnonzero(d)
        if not len(inside):
            continue
        first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
        size = np.diff(first, append=len(inside))
        place = np.arange(len(inside)) - np.repeat(first, size)
        power = _powers(1 << max(6, int(size.max()).bit_length()))
        hashes.append(np.add.reduceat(d[inside] * power[place], first))
        places.append(inside[first] + lo)
    at = np.concatenate(places)
    return mixed(np.concatenate(hashes)), np.diff(np.searchsorted(at, stop), prepend=0)


def runs(w: np.ndarray) -> np.ndarray:
    """The hash of each run of N of the words."""
    h = np.full(max(len(w) - N + 1, 0), N, np.uint64)
    for k in range(N):
        h = h * _P + w[k : len(w) - N + 1 + k] if len(h) else h
    return mixed(h)


def sequences(texts: list[str]) -> list[np.ndarray]:
    """For each text a 64-bit hash of each run of five words, in order. Texts of one to four words are one run; texts without words have none."""
    if not texts:
        return []
    w, n = words(texts)
    start = np.cumsum(n) - n
    h = runs(w)
    out = []
    for a, m in zip(start.tolist(), n.tolist(), strict=True):
        if m >= N:
            out.append(h[a : a + m - N + 1])
            continue
        x = np.full(min(m, 1), m, np.uint64)
        for k in range(m):
            x = x * _P + w[a + k]
        out.append(mixed(x))
    return out


def sequence(text: str) -> np.ndarray:
    return sequences([text])[0]
