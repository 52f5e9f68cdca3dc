"""Rolling hashes of byte ranges, for a whole text at a time."""

from __future__ import annotations

import numpy as np

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse (modulo 2^64), grown as texts need."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 65536 else 1 << 17
        for name, x in (("up", _STEP), ("down", _BACK)):
            out = np.full(size, x, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Ranges:
    """Hashes of any byte ranges [start, end) of one text."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of the ranges of one width, at every start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n] + np.uint64(width))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without space, \\t, \\n, \\v, \\f, \\r."""
    word = np.concatenate(([False], ~SPACES[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words (fewer words: of all of them)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    start, end = words(data)
    if not len(start):
        return np.empty(0, np.uint64)
    h = Ranges(data)(start, end)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i:i + n])
    return np.unique(out)
