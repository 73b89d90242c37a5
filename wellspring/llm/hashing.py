"""64-bit hashes of byte ranges and word shingles in numpy, alike in every process."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit value for each byte.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of ranges of a text from prefix sums of ``value(byte) * base**position``
    modulo 2**64; equal bytes hash alike wherever they stand."""

    def __init__(self):
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, 2 * len(self.power))
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n, base)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, text: np.ndarray) -> np.ndarray:
        """Prefix sums of a uint8 array."""
        self._grow(len(text))
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[text] * self.power[:len(text)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.inverse[start])


class Shingles:
    """Distinct hashed k-word shingles of whole texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer
    than ``k`` words has its whole sequence as one shingle, one without words none."""

    def __init__(self, k: int = 5):
        self.k = k
        self.ranges = Ranges()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        line = np.frombuffer(b" ".join(words), np.uint8)
        gaps = np.flatnonzero(line == 32)
        start = np.concatenate([[0], gaps + 1])
        end = np.concatenate([gaps, [len(line)]])
        m = max(1, len(words) - self.k + 1)
        last = end[self.k - 1:] if len(words) >= self.k else end[-1:]
        return np.unique(self.ranges.of(self.ranges.prefix(line), start[:m], last))
