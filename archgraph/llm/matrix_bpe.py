"""Byte-pair merges of many pre-tokens at once, on padded numpy matrices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

NONE = np.int32(2**31 - 1)
#: Pre-tokens of more bytes are merged one by one, all places of the best pair in a round.
LONG = 192
#: Cells of one matrix at most.
CELLS = 1_000_000
#: Entries of a generation of a worker's tables.
ENTRIES = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table (left id, right id) -> (rank, merged id), looked up by arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.key[slot] == -1
            self.key[slot[free]] = key[todo[free]]  # of several keys the last stays
            won = free & (self.key[slot] == key[todo])
            self.rank[slot[won]], self.merged[slot[won]] = rank[todo[won]], merged[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a slot without that key has rank NONE."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        got = self.key[slot]
        open_ = np.flatnonzero((got != key) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.key[slot[open_]]
            open_ = open_[(got != key[open_]) & (got != -1)]
        return slot


class MatrixMerger:
    """Encodes byte strings by a pair table: each row merges its leftmost pair of least rank, round by round."""

    def __init__(self, byte_ids: list[int], pairs: PairTable) -> None:
        self.byte_ids, self.pairs = np.array(byte_ids, np.int32), pairs

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list = [()] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        i = int(np.searchsorted(size[order], 1))
        while i < len(order):
            n = int(size[order[i]])
            if n > LONG:
                out[order[i]] = self._alone(pieces[order[i]])
                i += 1
                continue
            width = min(LONG, 1 << (n - 1).bit_length() if n > 1 else 1)  # the bucket of this length
            j = min(int(np.searchsorted(size[order], width, "right")), i + max(1, CELLS // width))
            self._bucket([pieces[k] for k in order[i:j]], order[i:j], out)
            i = j
        return out

    def _bucket(self, rows: list[bytes], where: np.ndarray, out: list) -> None:
        sizes = np.array([len(r) for r in rows])
        width = int(sizes.max())
        m = np.full((len(rows), width), -1, np.int32)
        m[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.pairs.rank[self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel())].reshape(len(rows), width - 1)
        while len(m):
            n, w = m.shape
            if w == 1:
                ended = np.ones(n, bool)
            else:
                at = rank.argmin(1)
                ended = rank[np.arange(n), at] == NONE
            if ended.any():
                for k, row in zip(where[ended].tolist(), m[ended].tolist(), strict=True):
                    while row[-1] == -1:
                        row.pop()
                    out[k] = tuple(row)
                live = ~ended
                m, where = m[live], where[live]
                if not len(m):
                    return
                rank, at = rank[live], at[live]
                n = len(m)
            # one pair of each row merges, so that every row gets shorter by one: compaction by a mask
            r = np.arange(n)
            m[r, at] = self.pairs.merged[self.pairs.find(m[r, at], m[r, at + 1])]
            keep = np.ones((n, w), bool)
            keep[r, at + 1] = False
            m = m[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[r, at] = False
            rank = rank[keep].reshape(n, w - 2)
            for rows_, cols in ((r[at > 0], at[at > 0] - 1), (r[at < w - 2], at[at < w - 2])):
                rank[rows_, cols] = self.pairs.rank[self.pairs.find(m[rows_, cols], m[rows_, cols + 1])]

    def _alone(self, piece: bytes) -> tuple[int, ...]:
        """One long row. All places of the best pair merge in a round, unless a merge makes a better pair."""
        find, ranks, merged = self.pairs.find, self.pairs.rank, self.pairs.merged
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = ranks[find(ids[:-1], ids[1:])]
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            start = np.r_[True, np.diff(at) > 1]
            at = at[(at - at[start][np.cumsum(start) - 1]) % 2 == 0]  # in a run of places every other one
            for places in (at, at[:1]):
                new = ids.copy()
                new[places] = merged[find(ids[places[:1]], ids[places[:1] + 1])]
                new = np.delete(new, places + 1)
                left = np.delete(rank, places)
                now = places - np.arange(len(places))
                near = np.unique(np.r_[now - 1, now])
                near = near[(near >= 0) & (near < len(new) - 1)]
                left[near] = ranks[find(new[near], new[near + 1])]
                if len(places) == 1 or not len(near) or left[near].min() > best:
                    break
            ids, rank = new, left
        return tuple(ids.tolist())


_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("[^\\sɐ-\U0010ffff]+")
#: The byte-level pattern for pre-tokens (fixed value); only under this one may texts be cut at spaces.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text below U+0250, where Python's classes tell letters and numbers.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Table(dict):
    """A bounded table of two generations: a full one becomes the old one, and what is looked up there moves on."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def turn(self) -> None:
        if len(self) > ENTRIES:
            self.old = dict(self)
            self.clear()

    def unknown(self, keys: Iterable) -> list:
        """The keys that neither generation has; those of the old one are taken over."""
        new = [k for k in keys if k not in self]
        if not self.old:
            return new
        get, out = self.old.get, []
        for k in new:
            v = get(k, self)
            if v is self:
                out.append(k)
            else:
                self[k] = v
        return out


class Units:
    """Values of texts, each the sum of the values of their pre-tokens.

    With ``cuts``, for which ``split`` must be the byte-level pattern, a text is cut at single
    spaces between two non-space characters. No pre-token of that pattern reaches over such a
    cut, since a single space joins what follows it; so the value of a unit depends on the unit
    alone. With any other pattern a text is one unit. Units and pre-tokens are kept in tables of
    bounded size, and new ones are split and merged together, a batch at a time.
    """

    def __init__(self, split: Callable[[str], list[str]], value: Callable[[list[str]], list], zero, cuts: bool = False, special: Iterable[str] = ()) -> None:
        self.split, self.value, self.zero, self.cuts = split, value, zero, cuts
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = cuts and not any(s.strip().isalpha() for s in special)  # no special string lies in a word of letters
        self.units, self.pieces = Table(), Table()

    def _value(self, piece_lists: Iterable[list[str]]) -> list:
        lists = list(piece_lists)
        todo = self.pieces.unknown({p for x in lists for p in x})
        if todo:
            self.pieces.update(zip(todo, self.value(todo), strict=True))
        get = self.pieces.__getitem__
        return [get(x[0]) if len(x) == 1 else sum(map(get, x), self.zero) for x in lists]

    def _learn(self, todo: list[str]) -> None:
        words, plain, odd = [], [], []
        for u in todo:
            if self.words and u.isalpha() and u.isascii():
                words.append(u)  # one pre-token as it is
            elif not u or u[0].isspace() or u[-1].isspace():
                self.units[u] = None  # what it is depends on its neighbours
            elif _PLAIN.fullmatch(u) and not (self.special and self.special.search(u)):
                plain.append(u)
            else:
                odd.append(u)
        if words:
            self.units.update(zip(words, self.value([" " + u for u in words]), strict=True))
        lists: list[list[str]] = []
        if plain:
            for p in _LATIN.findall("\n " + "\n ".join(plain)):
                if p == "\n":
                    lists.append([])
                else:
                    lists[-1].append(p)
        lists += [self.split(" " + u) for u in odd]
        self.units.update(zip(plain + odd, self._value(lists), strict=True))

    def _exact(self, s: str):
        return self._value([self.split(s)])[0]

    def batch(self, texts: list[str]) -> list[list]:
        """Of each text the values of its units, in order."""
        self.units.turn()
        self.pieces.turn()
        if not self.cuts:
            return [[v] for v in self._value(map(self.split, texts))]
        cut = [s.split(" ") for s in texts]
        self._learn(self.units.unknown(set().union(*[c[1:] for c in cut])))
        firsts = self._value([self.split(c[0]) for c in cut])
        get, out = self.units.__getitem__, []
        for s, c, f in zip(texts, cut, firsts, strict=True):
            row = [f, *map(get, c[1:])]
            if None in row or (c[0][-1:].isspace() if len(c) > 1 else False) or (not c[0] and len(c) > 1):
                row = self._recut(s)
            out.append(row)
        return out

    def _recut(self, s: str) -> list:
        c = _CUT.split(s)
        self._learn(self.units.unknown(set(c[1:-1])))
        row = [self._exact(c[0]), *map(self.units.__getitem__, c[1:-1])]
        return row if len(c) == 1 else [*row, self._exact(" " + c[-1])]


def portions(texts: list, chars: int = 1_000_000) -> Iterable[slice]:
    """Slices of ``texts`` of about so many characters each, whole texts only."""
    i = n = 0
    for j, s in enumerate(texts):
        n += len(s)
        if n >= chars:
            yield slice(i, j + 1)
            i, n = j + 1, 0
    if i < len(texts):
        yield slice(i, len(texts))
