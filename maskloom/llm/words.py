"""Words of many texts at once, as numpy arrays over the bytes of a chunk."""

from __future__ import annotations

import numpy as np

from maskloom.llm.common import mix64

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTERS = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xA5A5))
#: Base of the rolling hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse from 0 to n - 1; kept for the next chunk."""
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of letters times powers: the hash of data[s:e] is (sums[e] - sums[s]) * inverse**s."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it belongs to; words end where their text does."""
    inside = ~_BLANK[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1
