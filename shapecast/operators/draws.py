"""Poisson(1) weights of bootstrap draws, many at once (A10).

A weight is the inverse CDF at a 32-bit hash. ``md5_heads`` gives the hash of
``key:draw`` - the first 32 bits of its md5 - for all draws of a few rows by
array arithmetic: a row of the holdout has thousands of them, and as rows of a
table each would pass through the engine on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Hashes of a step of the loops: arrays of this length stay in a core's cache.
TILE = 1 << 14


def least_hashes(cdf: Sequence[float]) -> np.ndarray:
    """Of each k the least 32-bit hash h with h / 2^32 >= cdf[k]; those above all hashes are left out."""
    at = [math.ceil(c * 4294967296.0) for c in cdf]
    return np.array([t for t in at if t < 2**32], np.uint32)


def weights_of(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many values of the CDF are at or below h / 2^32."""
    out, above = np.zeros(h.shape, np.uint8), np.empty(h.shape, bool)
    for t in least:
        np.greater_equal(h, t, out=above)
        out += above.view(np.uint8)
    return out


def md5_words(words: np.ndarray) -> np.ndarray:
    """First 32 bits of the md5 of padded messages, one a column: (16 x blocks) x messages words."""
    n = words.shape[1]
    state = [np.full(n, s, np.uint32) for s in _START]
    f, spare = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
            f += a
            f += words[at + _WORDS[i]]
            f += np.uint32(_SINES[i])
            np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=spare)
            f <<= np.uint32(_SHIFTS[i])
            f |= spare
            f += b
            a, b, c, d, f = d, f, b, c, a
        for s, x in zip(state, (a, b, c, d)):
            s += x
    return state[0].byteswap()


def md5_heads(keys: Sequence[str | None], draws: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(numbers of some rows, first draw, rows x draws hashes): the first 32 bits of
    md5(key:draw) for draws 1.., as a number; without a key of md5(draw)."""
    by_length: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, k in enumerate(keys):
        head = b"" if k is None else k.encode() + b":"
        rows, heads = by_length.setdefault(len(head), ([], []))
        rows.append(i)
        heads.append(head)
    for length, (rows, heads) in by_length.items():
        head = np.frombuffer(b"".join(heads), np.uint8).reshape(len(rows), length)
        for digits in range(1, len(str(draws)) + 1):
            first, last = 10 ** (digits - 1), min(draws, 10**digits - 1)
            number = np.frombuffer(b"".join(b"%d" % d for d in range(first, last + 1)), np.uint8).reshape(-1, digits)
            size = length + digits
            blocks = (size + 8) // 64 + 1
            step = max(1, TILE // len(number))
            for at in range(0, len(rows), step):
                some = head[at:at + step]
                text = np.zeros((len(some), len(number), 64 * blocks), np.uint8)
                text[:, :, :length] = some[:, None, :]
                text[:, :, length:size] = number
                text[:, :, size] = 0x80
                text[:, :, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
                words = np.ascontiguousarray(text.reshape(-1, 64 * blocks).view("<u4").T)
                yield np.array(rows[at:at + step]), first, md5_words(words).reshape(len(some), len(number))
