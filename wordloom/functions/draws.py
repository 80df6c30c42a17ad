"""Draws that depend on a seed and keys only, many at a time, in numpy; some are the numbers of ``columns.uniform``."""

from __future__ import annotations

import hashlib
import math

import numpy as np

# The shifts and start of MD5 (RFC 1321).
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_PLACES = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)


def _md5_heads(words: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of blocks, as whole numbers; ``words``: 16 x n, the padded block of each message."""
    used = words.any(axis=1)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(61):  # the last three steps do not touch the first four bytes
        turn = i // 16
        if turn == 0:
            f = d ^ (b & (c ^ d))
        elif turn == 1:
            f = c ^ (d & (b ^ c))
        elif turn == 2:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += np.uint32(_SINES[i])
        if used[place := _PLACES[turn](i)]:
            f += words[place]
        shift = _SHIFTS[turn][i % 4]
        low = f >> np.uint32(32 - shift)
        f <<= np.uint32(shift)
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return (b + np.uint32(_START[0])).byteswap().astype(np.int64)


def heads(prefixes: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """2**32 times ``uniform`` for keys of which the last is a number from 1.

    ``prefixes``: the text of seed and other keys with a bar behind each, as an
    array of bytes; ``rows``: which of them each draw has.
    """
    digits = len(str(int(numbers.max(initial=1))))
    width = prefixes.dtype.itemsize
    if width + digits > 55:  # more than one block
        return np.array([int(hashlib.md5(prefixes[r] + str(n).encode()).hexdigest()[:8], 16) for r, n in zip(rows.tolist(), numbers.tolist(), strict=True)], np.int64)
    n = len(rows)
    held = np.zeros((len(prefixes), 64), np.uint8)
    held[:, :width] = np.frombuffer(prefixes.tobytes(), np.uint8).reshape(-1, width)
    end = np.char.str_len(prefixes)[rows]
    block = held[rows]
    size = np.ones(n, np.int64)
    for k in range(1, digits):
        size += numbers >= 10**k
    every, flat = 64 * np.arange(n), block.reshape(-1)
    for k in range(digits):  # from the last digit on
        at = np.flatnonzero(size > k)
        flat[every[at] + end[at] + size[at] - 1 - k] = 48 + numbers[at] // 10**k % 10
    flat[every + end + size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = 8 * (end + size)
    return _md5_heads(words)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits with their bits mixed (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def standard_gammas(shape: np.ndarray, *keys: np.ndarray | int) -> np.ndarray:
    """Gamma draws of the given shapes (rows x columns); each depends on its row's keys, its column and its shape alone.

    Marsaglia and Tsang's method (2000): normal draws are taken or refused
    until all are taken; shapes below 1 are drawn one higher and scaled.
    """
    state = np.zeros(len(shape), np.uint64)
    for key in keys:
        state = _mixed(state ^ np.asarray(key, np.int64).astype(np.uint64))
    flat = shape.reshape(-1).astype(float)
    states = _mixed(state[:, None] + np.arange(shape.shape[1], dtype=np.uint64)).reshape(-1)
    turns = 0

    def uniforms(of: np.ndarray) -> np.ndarray:
        """Another number in (0, 1) of each state."""
        nonlocal turns
        turns += 1
        return ((_mixed(of + np.uint64(turns * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52

    scale = np.where(flat < 1, uniforms(states) ** (1 / np.minimum(flat, 1)), 1.0)
    d = np.where(flat < 1, flat + 1, flat) - 1 / 3
    out, left = np.empty(len(flat)), np.arange(len(flat))
    while len(left):
        of, own = states[left], d[left]
        x = np.sqrt(-2 * np.log(uniforms(of))) * np.cos(2 * np.pi * uniforms(of))
        v = (1 + x / np.sqrt(9 * own)) ** 3
        taken = np.log(uniforms(of)) < 0.5 * x * x + own - own * v + own * np.log(np.maximum(v, 1e-300))
        taken &= v > 0
        out[left[taken]] = (own * v)[taken]
        left = left[~taken]
    return (out * scale).reshape(shape.shape)
