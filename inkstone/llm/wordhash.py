"""Vectorised hashing of words and word shingles (numpy, inside tasks).

Words are runs without blanks and x09 to x0D of the UTF-8 bytes, A-Z in lower
case.  Hashes are 64 bits, the same in every process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at once; longer input is cut at white space.
SEGMENT = 1 << 18
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 20)) * U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = stream(256, 1)[_LOWER]
_PLACE = stream(SHINGLE, 2) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, U)
            p[0] = U(1)
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers


def _hashes(texts: list[bytes], apart: np.ndarray, leads: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words between ``apart`` bytes, then of their first ``leads`` bytes, and where each text begins."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    places, hashes = [np.zeros(0, np.int64)], [[np.zeros(0, U)] for _ in range(1 + len(leads))]
    at, end = 0, len(data) if texts else 0
    while at < end:
        stop = min(at + SEGMENT, end)
        while stop < end and not apart[data[stop - 1]]:
            ahead = np.flatnonzero(apart[data[stop:stop + SEGMENT]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + SEGMENT, end)
        part = data[at:stop]
        edge = np.diff(np.concatenate(([1], apart[part].view(np.int8), [1])))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power(max(len(part), 2))
        total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[part] * power[:len(part)], dtype=U)))
        for k, until in enumerate([last, *(np.minimum(first + n, last) for n in leads)]):
            hashes[k].append(mix((total[until] - total[first]) * inverse[first] + (until - first).astype(U)))
        places.append(first + at)
        at = stop
    return [np.concatenate(h) for h in hashes], np.searchsorted(np.concatenate(places), begins)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of ``texts`` in order, and where each text's words begin (one more entry than texts)."""
    (words,), begins = _hashes(texts, _SPACE)
    return words, begins


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters, digits and bytes beyond ASCII: hashes of each, of its first four and first five bytes; begins."""
    (words, four, five), begins = _hashes(texts, _APART, (4, 5))
    return words, four, five, begins


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than five make one shingle, none make none."""
    h, begins = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = len(h)
        rolled = np.zeros(0, U)
        if n >= SHINGLE:
            rolled = mix(sum(h[k:n - SHINGLE + 1 + k] * _PLACE[k] for k in range(SHINGLE)))
        out = []
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(rolled[a:b - SHINGLE + 1]))
            elif b > a:
                few = np.add.reduce(h[a:b] * _PLACE[:b - a], dtype=U)
                out.append(mix(np.array([few + U(b - a)], U)))
            else:
                out.append(np.zeros(0, U))
    return out
