"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from prismal.llm.common import SPACES, worker_cache

_IS_SPACE = np.zeros(256, np.bool_)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for texts of usual length."""

    def make(size: int):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, inverse))

    usual = 1 << 21
    return worker_cache(("powers",), lambda: make(usual)) if n <= usual else make(n)


def words(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word, and the text that holds it. ``ends``: 0 and the end of each text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_IS_SPACE[raw], [False]])
    cut = np.zeros(len(raw) + 1, np.bool_)
    cut[ends] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)[: len(raw) + 1])
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return first, last, np.searchsorted(ends, first, "right") - 1


def word_hashes(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from differences of a running polynomial."""
    power, inverse = _powers(len(data) + 1)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(raw) * power[: len(raw)])])
    return mix((running[last] - running[first]) * inverse[first] + (last - first).astype(np.uint64) * _ODD)


def shingles(data: bytes, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: hash, text number (ascending) and how often the text has it.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    first, last, owner = words(data, ends)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = word_hashes(data, first, last)
    count = np.bincount(owner, minlength=len(ends) - 1)
    begin = np.cumsum(count) - count
    size = np.minimum(count, width)[owner]
    starts = np.flatnonzero(np.arange(len(first)) + size <= (begin + count)[owner])
    starts = starts[(size[starts] == width) | (starts == begin[owner[starts]])]
    out = np.zeros(len(starts), np.uint64)
    for i in range(width):
        has = size[starts] > i
        at = np.minimum(starts + i, len(hashed) - 1)
        out = np.where(has, mix(out + hashed[at] + np.uint64(i + 1)), out)
    text = owner[starts]
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    return out[at], text[at], np.diff(np.append(at, len(out)))
