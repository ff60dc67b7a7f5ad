"""Elias-Fano coding of monotone sequences in numpy: build once, query many values at a time.

A sequence of n values under u keeps the low l = log2(u / n) + 2 bits of each value packed and the high parts in unary, as
a bit vector with a one for each value and a zero for each step of the high part: about l + 1.5 bits a value. The
positions of the zeros are kept as a directory (8 bits a value), so a value is sought among the few of its high part without a
scan; those of every STEP-th one serve get(). Arrays are plain buffers, so they can lie in a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
STEP = 8


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, end to end, least bit first, as 64-bit words with one to spare."""
    if width == 0 or not len(values):
        return np.zeros(2, U64)
    out = []
    for at in range(0, len(values), 1 << 16):  # 65536 * width bits end on a word
        part = values[at : at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        b = np.packbits(bits.reshape(-1), bitorder="little")
        out.append(np.append(b, np.zeros(-len(b) % 8, np.uint8)).view("<u8"))
    return np.concatenate([*out, np.zeros(2, U64)]).astype(U64)


def _positions(words: np.ndarray, ones: bool) -> np.ndarray:
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")
    found = np.flatnonzero(bits if ones else bits == 0)
    return found.astype(np.uint32 if len(bits) < 2**32 else np.int64)


def build(values: np.ndarray, name: str, ones: bool = False) -> dict[str, np.ndarray]:
    """Arrays of a rising sequence of uint64 under keys that begin with name. ones: so that get() works too."""
    values = np.asarray(values, U64)
    n = len(values)
    last = int(values[-1]) if n else 0
    low = max(0, (last // max(n, 1)).bit_length() - 1 + 2)
    high = (values >> U64(low)).astype(np.int64)
    size = n + (last >> low) + 2
    bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8").astype(U64)
    out = {f"{name}.meta": np.array([n, low, last >> low], np.int64), f"{name}.high": words, f"{name}.zeros": _positions(words, False)[: (last >> low) + 1]}
    out[f"{name}.low"] = _packed(values & U64((1 << low) - 1), low)
    if ones:
        out[f"{name}.ones"] = _positions(words, True)[::STEP]
    return out


def _select(words: np.ndarray, samples: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions of the ones numbered k."""
    pos = samples[k // STEP].astype(np.int64)
    rest = (k % STEP).astype(np.int64)
    word = pos >> 6
    cur = words[word] & (~U64(0) << (pos & 63).astype(U64))
    n = np.bitwise_count(cur).astype(np.int64)
    todo = np.flatnonzero(rest >= n)
    while len(todo):
        rest[todo] -= n[todo]
        word[todo] += 1
        cur[todo] = words[word[todo]]
        n[todo] = np.bitwise_count(cur[todo])
        todo = todo[rest[todo] >= n[todo]]
    at = word << 6
    for half in (32, 16, 8, 4, 2, 1):
        low = cur & U64((1 << half) - 1)
        c = np.bitwise_count(low).astype(np.int64)
        up = rest >= c
        rest -= np.where(up, c, 0)
        cur = np.where(up, cur >> U64(half), low)
        at += np.where(up, half, 0)
    return at


class Sequence:
    """Queries on the arrays that build() made."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low, self.top = (int(x) for x in arrays[f"{name}.meta"])
        self.high, self.zeros, self.lows, self.ones = (arrays.get(f"{name}.{k}") for k in ("high", "zeros", "low", "ones"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.low == 0:
            return np.zeros(len(i), U64)
        bit = i.astype(U64) * U64(self.low)
        word, shift = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        carry = np.where(shift > 0, self.lows[word + 1] << (U64(64) - np.maximum(shift, U64(1))), U64(0))
        return ((self.lows[word] >> shift) | carry) & U64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (_select(self.high, self.ones, i) - i).astype(U64)
        return (high << U64(self.low)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each value in a strictly rising sequence, -1 where it isn't there: the first value that isn't
        less than x is sought among those of x's high part, and compared."""
        x = np.asarray(x, U64)
        out = np.full(len(x), -1, np.int64)
        high = x >> U64(self.low)
        ask = np.flatnonzero(high <= U64(self.top)) if self.n else np.empty(0, np.int64)
        if not len(ask):
            return out
        h = high[ask].astype(np.int64)
        low = x[ask] & U64((1 << self.low) - 1)
        hi = self.zeros[h].astype(np.int64) - h
        lo = np.where(h > 0, self.zeros[np.maximum(h - 1, 0)].astype(np.int64) + 1 - h, 0)
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # the first value of [lo, hi) that isn't less
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        here = np.flatnonzero(lo < end)
        hit = here[self._low(lo[here]) == low[here]]
        out[ask[hit]] = lo[hit]
        return out
