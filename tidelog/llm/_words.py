"""Words of texts as 64-bit hashes, computed over flat arrays of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BLOCK = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
            grown[0] = 1
            _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def words(body: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end byte of every word.

    Words are runs of bytes other than space and 0x09 to 0x0D inside a row;
    ``lower`` lower-cases A to Z first.
    """
    parts = []
    bounds = offsets[1:-1]
    begin, size = 0, len(body)
    while begin < size:
        end = min(size, begin + _BLOCK)
        while end < size:  # a block ends at a space or at a row's end
            gap = np.flatnonzero(_SPACE[body[end : end + 65536]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(size, end + 65536)
        parts.append(_block(body[begin:end], bounds[(bounds > begin) & (bounds < end)] - begin, begin, lower))
        begin = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes, starts, ends = (np.concatenate(p) for p in zip(*parts, strict=True))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, rows, starts, ends


def _block(body: np.ndarray, cuts: np.ndarray, base: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[body]
    before = np.empty(len(body), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(body), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lens = ends - starts
    total = int(lens.sum())
    at = np.cumsum(lens) - lens
    nth = np.arange(total) - np.repeat(at, lens)
    values = (_LOWER[body] if lower else body)[inside].astype(np.uint64)
    with np.errstate(over="ignore"):
        values = (values + np.uint64(1)) * powers(int(lens.max()) if total else 1)[nth]
        sums = np.add.reduceat(values, at)
        hashes = mix(sums ^ (lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return hashes, starts + base, ends + base


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each position on (positions with k words ahead in the array)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * (np.uint64(0xC2B2AE3D27D4EB4F) ** np.uint64(j + 1))
        return mix(total, salt)
