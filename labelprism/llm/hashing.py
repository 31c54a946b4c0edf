"""64-bit hashes of ranges, from sums over prefixes."""

from __future__ import annotations

import numpy as np

__all__ = ["U", "mix", "powers", "PrefixHashes"]

U = np.uint64
#: An odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash (the finisher of splitmix64; fixed values)."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to ``n``."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(n + 1, base, U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


class PrefixHashes:
    """Hashes of columns ``start`` to ``end`` of every row of a matrix of integers."""

    def __init__(self, rows: np.ndarray):
        n, length = rows.shape
        up, self.down = powers(length)
        self.sums = np.zeros((length + 1, n), U)  # a column's values side by side
        np.cumsum((mix(rows.astype(U) + U(1)) * up[:length]).T, axis=0, out=self.sums[1:])

    def of(self, start: int, end: int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + U(end - start))
