"""Elias-Fano sequences and tries of n-grams as flat buffers that can be memory-mapped (operator 11).

A trie holds the runs of one, two and three words that start with some words. Each level keeps the
words of all nodes, sibling after sibling, as one monotone sequence: a word's number plus the last
value of the siblings before, so that a context's successors are searched relative to where that
context begins. Monotone pointers say where the children of each node begin; next to the words stand
quantised probabilities. All parts are views on one buffer, read in place.
"""

from __future__ import annotations

import mmap
from pathlib import Path

import numpy as np

#: Codes of shares: -4096 * log10, so that a step is 0.06 %; the last code is zero.
STEP, ZERO = 4096, 65535
_SHARES = np.append(10.0 ** (-np.arange(ZERO) / STEP), 0.0)
_ONE = np.uint64(1)


def quantise(share: np.ndarray) -> np.ndarray:
    """Codes (uint16) of shares from 0 to 1."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(share) * STEP)
    return np.where(share > 0, np.minimum(code, ZERO - 1), ZERO).astype(np.uint16)


def shares(code: np.ndarray) -> np.ndarray:
    """The shares (doubles) behind codes."""
    return _SHARES[code]


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one in each 64-bit word, by halves."""
    word, k, at = word.copy(), k.astype(np.uint64), np.zeros(len(word), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.uint64)
        up = k >= ones
        k -= ones * up
        jump = up * np.uint64(step)
        word >>= jump
        at += jump
    return at.astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: ``low`` bits of each value packed, the rest in unary with a rank for each word."""

    def __init__(self, buffer: np.ndarray) -> None:
        """A view on what :meth:`pack` gave, as uint64."""
        self.n, self.low_bits, lows, highs = (int(x) for x in buffer[:4])
        self.low = buffer[4 : 4 + lows]
        self.high = buffer[4 + lows : 4 + lows + highs]
        self.rank = buffer[4 + lows + highs : 4 + lows + 2 * highs].view(np.int64)  # ones before each word
        self.mask = np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def pack(values: np.ndarray) -> np.ndarray:
        n, v = len(values), values.astype(np.uint64)
        most = int(v[-1]) + 1 if n else 1
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        at = np.arange(n, dtype=np.int64) * bits
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            word, shift, part = at >> 6, (at & 63).astype(np.uint64), v & np.uint64((1 << bits) - 1)
            heads = np.flatnonzero(np.diff(word, prepend=-1))  # parts of a word have no bit in common, so a sum joins them
            low[word[heads]] += np.add.reduceat(part << shift, heads)
            low[word[heads] + 1] += np.add.reduceat((part >> _ONE) >> (np.uint64(63) - shift), heads)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(ones[-1]) + 2 if n else 1) + 63) // 64 * 64, np.uint8)
        unary[ones] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        rank = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        return np.concatenate([np.array([n, bits, len(low), len(high)], np.uint64), low, high, rank.astype(np.uint64)])

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (np.uint64(63) - shift))) & self.mask if self.low_bits else np.zeros(len(i), np.uint64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at ``i``."""
        word = np.searchsorted(self.rank, i, side="right") - 1
        at = word * 64 + _select(self.high[word], i - self.rank[word])
        return ((at - i) << self.low_bits) + self._low(i).astype(np.int64)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``h``."""
        out, some = np.zeros(len(h), np.int64), h > 0
        z = h[some] - 1  # the zero that ends the bucket before
        zeros = np.arange(len(self.rank)) * 64 - self.rank
        word = np.searchsorted(zeros, z, side="right") - 1
        out[some] = word * 64 + _select(~self.high[word], z - zeros[word]) - z
        return out

    def _bounds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, exclusive, of the values with high part ``h``: a run of ones between two zeros."""
        start = self._bucket(h)
        at = start + h
        word, shift = at >> 6, at & 63
        gap = ~(self.high[word] >> shift.astype(np.uint64))
        run = np.bitwise_count((gap & (~gap + _ONE)) - _ONE).astype(np.int64)  # ones below the lowest zero
        end, over = start + run, np.flatnonzero(shift + run >= 64)
        end[over] = self._bucket(h[over] + 1)
        return start, end

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value ``x``, the first one of equal values, or -1: the successor of x if it is x itself."""
        out = np.full(len(x), -1)
        most = len(self.high) * 64 - self.n  # zeros, that is high parts that end in the vector
        some = np.flatnonzero((x >> self.low_bits) < most) if self.n else np.empty(0, np.int64)
        h, low = x[some] >> self.low_bits, x[some].astype(np.uint64) & self.mask
        lo, end = self._bounds(h)
        hi, open_ = end.copy(), np.arange(len(some))
        while len(open_ := open_[lo[open_] < hi[open_]]):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        there = lo < end
        there[there] = self._low(lo[there]) == low[there]
        out[some[there]] = lo[there]
        return out


def _siblings(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words of nodes as one increasing sequence: each plus the last value of the siblings before; ``first``: where each context's begin."""
    last = words[np.append(first[1:], len(words)) - 1] + 1
    base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64)
    return np.repeat(base, np.diff(np.append(first, len(words)))) + words + 1


def _codes(code: np.ndarray) -> np.ndarray:
    return np.frombuffer(code.tobytes() + b"\0" * (-2 * len(code) % 8), np.uint64)


class Trie:
    """Words, pairs and triples with quantised shares, read in place from one buffer."""

    PARTS = ("words", "to_pairs", "pairs", "pair_share", "back_off", "to_triples", "triples", "triple_share")

    def __init__(self, buffer) -> None:
        whole = np.frombuffer(buffer, np.uint64)
        ends = 8 + np.cumsum(whole[:8].astype(np.int64))
        for name, start, end in zip(self.PARTS, np.append(8, ends[:-1]), ends, strict=True):
            part = whole[start:end]
            setattr(self, name, part.view(np.uint16) if name in ("pair_share", "back_off", "triple_share") else EliasFano(part))

    @staticmethod
    def build(u: np.ndarray, v: np.ndarray, pair_share: np.ndarray, back_off: np.ndarray, n_triples: np.ndarray, w: np.ndarray, triple_share: np.ndarray) -> bytes:
        """The buffer of distinct pairs, sorted by (u, v), and their ``n_triples`` successors w each, sorted."""
        heads = np.flatnonzero(np.diff(u, prepend=-1))
        to_triples = np.concatenate([[0], np.cumsum(n_triples)]).astype(np.int64)
        full = to_triples[:-1][n_triples > 0]
        parts = [
            EliasFano.pack(u[heads]), EliasFano.pack(np.append(heads, len(u))), EliasFano.pack(_siblings(heads, v) if len(u) else v), _codes(quantise(pair_share)), _codes(quantise(back_off)),
            EliasFano.pack(to_triples), EliasFano.pack(_siblings(full, w) if len(w) else w), _codes(quantise(triple_share))]
        return np.concatenate([np.array([len(p) for p in parts], np.uint64), *parts]).tobytes()

    @classmethod
    def map(cls, path: str | Path) -> Trie:
        """The trie of a file, memory-mapped."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def _search(level: EliasFano, pointer: EliasFano, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word among the children of its context, or -1. Neighbours with the same context share what it takes to get there."""
        heads = np.flatnonzero(np.diff(context, prepend=-1))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(context))))
        first, end = pointer.get(context[heads]), pointer.get(context[heads] + 1)
        base, some = np.zeros(len(heads), np.int64), first > 0
        base[some] = level.get(first[some] - 1)
        node = level.find(base[of] + word + 1)
        return np.where(node < end[of], node, -1)

    def pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Node of each pair, or -1: v is searched among the successors of u."""
        heads = np.flatnonzero(np.diff(u, prepend=-1))
        at = np.repeat(self.words.find(u[heads]), np.diff(np.append(heads, len(u))))
        out, some = np.full(len(u), -1), np.flatnonzero(at >= 0)
        if len(some):
            out[some] = self._search(self.pairs, self.to_pairs, at[some], v[some])
        return out

    def triple(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Node of each triple, or -1: w is searched among the successors of the node ``pair``."""
        out, some = np.full(len(pair), -1), np.flatnonzero(pair >= 0)
        if len(some) and self.triples.n:
            out[some] = self._search(self.triples, self.to_triples, pair[some], w[some])
        return out
