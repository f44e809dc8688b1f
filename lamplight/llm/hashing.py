"""Hashes of substrings of a byte string, all at once: polynomials over 64-bit codes of the bytes, modulo 2 ** 64."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                both.append(np.multiply.accumulate(powers))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Hashes:
    """Hashes of substrings of one byte string in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all_of(self, length: int) -> np.ndarray:
        return mixed((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])
