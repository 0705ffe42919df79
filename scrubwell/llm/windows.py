"""Words and hashes of runs of words, vectorised; shared by the operators on shingles and windows."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd factor, so it has an inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the factor and its inverse, as far as any text so far needed them."""

    up = _powers(_FACTOR, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            m = 1 << n.bit_length()
            cls.up, cls.down = _powers(_FACTOR, m), _powers(_INVERSE, m)
        return cls.up[:n], cls.down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def word_hashes_128(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in words]), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that order and low bits of the hashes are even."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = Powers.of(len(words))
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up, out=total[1:])
    return total, down


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words: a polynomial in the words' hashes, by prefix sums."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, down = _prefix(words)
    return mix((total[length:] - total[:n]) * down[:n])


def span_hashes(words: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The same for runs of ``count`` words from each ``start``."""
    total, down = _prefix(words)
    return mix((total[start + count] - total[start]) * down[start])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` consecutive values, the leftmost among equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, step = np.arange(len(h)), 1
    while step < width:  # blocks of doubling size, the last step overlaps
        move = min(step, width - step)
        a, b = at[:-move], at[move:]
        at = np.where(h[b] < h[a], b, a)
        step += move
    return at[:n]
