"""Hashes of all stretches of a byte array at once, and anchors: positions that equal windows choose alike."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd multiplier.
_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


class Stretches:
    """hash(a, b) of bytes[a:b] for arrays a, b: a polynomial modulo 2^64 in random byte values, with a finalising mix."""

    def __init__(self, data: np.ndarray) -> None:
        """data: bytes, or any values as uint64."""
        power, self.inverse = _up_to(len(data) + 1)
        value = _VALUE[data] if data.dtype == np.uint8 else data
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(data)])])

    def hash(self, a, b) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.inverse[a]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def slide(a: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over a[i : i + width] for every i; beyond the end there is fill."""
    have = 1
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(a, fill)
        moved[: max(0, len(a) - step)] = a[step:]
        a = op(a, moved)
        have += step
    return a


def anchors(h: np.ndarray, window_ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window): the windows [j, j + width) of positions that choose each position.

    A window, where window_ok[j], chooses its leftmost position of smallest h. What it chooses depends on what it
    holds only, so windows of equal content choose equal places; every allowed window chooses one place.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not window_ok.any():
        return none
    key = (h >> np.uint64(32)).astype(np.uint32)
    key = np.maximum(key, 1)  # 0 marks windows that are not allowed
    low = np.where(window_ok, slide(key, width, np.minimum, np.uint32(0xFFFFFFFF)), np.uint32(0))
    high = slide(low[::-1], width, np.maximum, np.uint32(0))[::-1]
    at = np.flatnonzero(high == key)
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = np.append(starts[1:], len(low)) - 1
    used = low[starts] > 0
    starts, ends = starts[used], ends[used]
    span = np.int64(1) << 32
    run = low[starts].astype(np.int64) * span + starts
    order = np.argsort(run)
    run, run_start, run_end = run[order], starts[order], ends[order]
    place = key[at].astype(np.int64) * span + at
    by = np.argsort(place)
    at, place = at[by], place[by]
    value = place // span
    before = np.concatenate([[-1], np.where(value[1:] == value[:-1], at[:-1], -1)])
    lo = np.maximum(np.maximum(at - width + 1, before + 1), 0)
    found = np.searchsorted(run, place, side="right") - 1
    ok = (found >= 0) & (run[found] // span == value) if len(run) else np.zeros(len(at), bool)
    lo, hi = np.maximum(lo, run_start[found]), np.minimum(at, run_end[found])
    ok &= lo <= hi
    at, lo, hi = at[ok], lo[ok], hi[ok]
    order = np.argsort(at)
    return at[order], lo[order], hi[order]
