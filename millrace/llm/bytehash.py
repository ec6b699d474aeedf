"""Prefix polynomial hashes over byte arrays, and windows picked by smallest hash.

Hash of ``b[i:j]``: ``sum(code(b[t]) * BASE**(t-i))`` modulo 2**64. With prefix sums of
``code(b[t]) * BASE**t`` a slice costs one subtraction and one multiplication by an inverse
power, since an odd base has an inverse. Equal slices always have equal hashes; unequal slices
with equal hashes are possible, so whoever uses them compares the bytes as well.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
# one odd 64-bit code per byte value, by a rule
_CODES = np.array([(pow(0xD6E8FEB86659FD93, v + 2, 1 << 64) ^ (v << 17)) | 1 for v in range(256)], dtype=np.uint64)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents below ``n``."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = _table(int(BASE), size)
        _inverses = _table(pow(int(BASE), -1, 1 << 64), size)
    return _powers[:n], _inverses[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``len(data) + 1`` prefix sums."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def slices(prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hashes of the slices ``[start, start + length)``."""
    inverse = powers(len(prefix))[1]
    return (prefix[start + length] - prefix[start]) * inverse[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all bits (its low bits alone are weak)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_LOW = np.uint64((1 << 24) - 1)
PIECE = 1 << 23  # bytes looked at together; a place within a piece fits the low 24 bits


def picked(prefix: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, at): runs of window starts ``first..last`` that pick the gram at ``at``.

    A window of ``window`` bytes picks its gram of ``gram`` bytes with the smallest mixed hash, the
    leftmost of equal ones, so equal windows pick the same place wherever they stand. The hash and
    the place share one number, and the smallest of a sliding run is found by doubling.
    """
    n, width = len(prefix) - 1, window - gram + 1
    out = []
    for low in range(0, n - window + 1, PIECE):
        high = min(low + PIECE, n - window + 1)  # window starts of this piece
        place = np.arange(low, high + width - 1)
        best = mix(slices(prefix, place, gram)) & ~_LOW | (place - low).astype(np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            best = np.minimum(best[step:], best[: len(best) - step])
            span += step
        cut = np.flatnonzero(best[1:] != best[:-1])
        first = np.concatenate(([0], cut + 1))
        last = np.concatenate((cut, [len(best) - 1]))
        out.append((first + low, last + low, (best[first] & _LOW).astype(np.int64) + low))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
