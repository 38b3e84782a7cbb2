"""Removal of repeated passages by a run-length index (operator 9).

A passage of ``length`` bytes that also starts earlier is to go. Equal passages have equal least
k-grams at equal places, so each window of ``length`` bytes belongs to one anchor, the k-gram of
least hash in it, and passages can only repeat among the windows of anchors with equal hashes.
The windows of an anchor form one context of at most 2 * length bytes. Contexts that are equal as
a whole are settled by their hashes: all but the first go. The first ones of different contexts
with an equal anchor are put together in chunks of bounded size, in the order of the corpus; a
chunk gets an r-index: the run-length Burrows-Wheeler transform with the suffix array sampled at
the ends of runs. From these samples alone follow, for each position in the order of the text,
its neighbour in the suffix array and the length of their match; matches of ``length`` or more
are followed to the earliest position, and all later ones are marked. An anchor with more contexts
than an index takes gets several: its windows are parted by the place of the anchor in them and by
the bytes that all windows of such a part have in common, again and again until each part fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, settle

#: Bytes of a chunk's text, about, and contexts of one key that an index takes.
CHUNK, MANY = 1_000_000, 4000
#: Bytes of a text whose anchors are found at a time; rows that a task dedupes before they are shuffled.
BLOCK, ROWS = 4_000_000, 1_000_000
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = -(1 << 63)


class RunLengthIndex:
    """The r-index of texts: suffix array samples at the run ends of their joint BWT.

    Texts are separated by characters that occur once and sort after all bytes, so that no match
    reaches over the end of a text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(size + 1)[:-1]]
        self.n = n = int(size.sum()) + len(texts)
        t = np.empty(n, np.int64)
        ends = self.starts + size
        t[ends] = np.arange(256, 256 + len(texts))
        inside = np.ones(n, bool)
        inside[ends] = False
        t[inside] = np.frombuffer(b"".join(texts), np.uint8)
        sa = self._suffix_array(t)
        bwt = t[sa - 1]  # of the first suffix the last character
        head = np.r_[True, bwt[1:] != bwt[:-1]]
        at = np.flatnonzero(head)
        self.run_char, self.run_length = bwt[at], np.diff(np.r_[at, n])
        first, before = sa[at], np.r_[-1, sa[at[1:] - 1]]  # samples: each run's first, and the last of the run before
        order = np.argsort(first)
        self.first, self.before = first[order], before[order]
        self.match = self._common(t, self.first, self.before)

    @staticmethod
    def _suffix_array(t: np.ndarray) -> np.ndarray:
        """By prefix doubling from four characters on; the separators make it end."""
        n, bits = len(t), max(9, int(t.max()).bit_length() + 1)
        step = max(1, 62 // bits)
        step = 1 << (step.bit_length() - 1)
        padded = np.r_[t + 1, np.zeros(step, np.int64)]
        key = np.zeros(n, np.int64)
        for i in range(step):
            key = key << bits | padded[i : i + n]
        while True:
            sa = np.argsort(key)
            new = np.r_[False, np.diff(key[sa]) != 0]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new)
            if new[1:].all():
                return sa
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            step *= 2

    @staticmethod
    def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, 0 where b is -1."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        a, b, end = a[live], b[live], len(t)
        k = 0
        while len(live):
            ok = (a + k < end) & (b + k < end)
            ok[ok] = t[a[ok] + k] == t[b[ok] + k]
            out[live[~ok]] = k
            live, a, b = live[ok], a[ok], b[ok]
            k += 1
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(neighbour, length) of each position in text order: the suffix before it in the suffix array and their common prefix.

        Between two sampled positions both move along with the text, so r samples tell all n.
        """
        span = np.diff(np.r_[self.first, self.n])
        off = np.arange(self.n) - np.repeat(self.first, span)
        return np.repeat(self.before, span) + off, np.repeat(self.match, span) - off

    def later(self, length: int) -> np.ndarray:
        """True at positions where ``length`` characters also start earlier."""
        neighbour, match = self.matching_statistics()
        here = np.arange(self.n)
        root = np.where(match >= length, neighbour, here)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        earliest = np.full(self.n, self.n)
        np.minimum.at(earliest, root, here)
        return earliest[root] < here


def _anchor_hashes(raw: bytes, k: int) -> np.ndarray:
    a = np.frombuffer(raw + b"\0" * 8, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, 8)).view(np.uint64).ravel()
    n = len(raw) - k + 1
    h = words[:n] * _MIX
    for s in range(8, k, 8):
        h = (h ^ (h >> np.uint64(31))) * _MIX + words[s : s + n] * _MIX2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the leftmost least hash, by its upper 40 bits, in each window of ``w`` hashes; at most 2 ** 24 hashes."""
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= w:  # least of spans of doubling width; two of them cover a window
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


def contexts(raw: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, first window, windows) of the contexts of a text, which part its windows."""
    out = []
    w = length - k + 1
    for s in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = raw[s : s + BLOCK + length - 1]
        h = _anchor_hashes(part, k)
        at = _least(h, w)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[first, len(at)])
        x = np.fromiter((xxhash.xxh64_intdigest(part[f:e]) for f, e in zip(first.tolist(), (first + n + (length - 1)).tolist(), strict=True)), np.uint64, len(first))
        out.append((h[at[first]].view(np.int64), x.view(np.int64), first + s, n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def _same_as_first(new: np.ndarray, *cols: np.ndarray) -> np.ndarray:
    """True where the columns are as in the first row of the run that ``new`` starts: a row repeated as a whole."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.logical_and.reduce([c == c[first] for c in cols])


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], names)


_ROW = ["a", "x", "doc", "row", "p", "c"]


def _extract(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of contexts (c windows from p on), each context once for some rows of the task; and with c = -1 the spans p to x that repeat one."""
        held: list = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            held.sort(key=lambda t: (t[2][0], t[3][0]))  # whole texts, so that the stable sort keeps the order of the corpus
            a, x, doc, row, p, c = (np.concatenate(col) for col in zip(*held, strict=True))
            order = np.lexsort((x, a))
            a, x, doc, row, p, c = (v[order] for v in (a, x, doc, row, p, c))
            new = np.r_[True, (a[1:] != a[:-1]) | (x[1:] != x[:-1])]
            yield _batch(_ROW, a[new], x[new], doc[new], row[new], p[new], c[new])
            rest = ~_same_as_first(new, doc, row, p)
            if rest.any():
                doc, row, p, c = (v[rest] for v in (doc, row, p, c))
                order = np.lexsort((p, row, doc))
                doc, row, p, e = doc[order], row[order], p[order], (p + c + length - 1)[order]
                apart = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (p[1:] > e[:-1])]
                first = np.flatnonzero(apart)
                yield _batch(_ROW, row[first], np.maximum.reduceat(e, first), doc[first], row[first], p[first], np.full(len(first), -1))

        for b in batches:
            for doc, row, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                a, x, p, c = contexts(s.as_py().encode(), length, k)
                if len(a):
                    held.append((a, x, np.full(len(a), doc), np.full(len(a), row), p, c))
                    n += len(a)
                if n >= ROWS:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    return run


def _settle_equal(length: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, a, doc, row, s, e): kind 0 a span to remove; 1 the first of several contexts of a key; 2 the same beyond ``many``.

        Rows come sorted by key, context and corpus order. Of the last key of a batch only its
        first row and that of its last context are carried on, whatever the number of its rows.
        """
        names = ["kind", "a", "doc", "row", "s", "e"]
        # the open key: its value, distinct contexts so far, whether its first row is still held back, that row, the last context's first row
        open_a = None
        distinct, waiting, last = 0, None, None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            is_span = cols[5] < 0
            if is_span.any():
                _, x, doc, row, p, _ = (c[is_span] for c in cols)
                zero = np.zeros(len(x), np.int64)
                yield _batch(names, zero, zero, doc, row, p, x)
                cols = [c[~is_span] for c in cols]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.r_[v, c] for v, c in zip(last, cols, strict=True)]  # that row again, as a base to compare with
            a, x, doc, row, p, c = cols
            n = len(a)
            new_a = np.r_[True, a[1:] != a[:-1]]
            new = np.r_[True, new_a[1:] | (x[1:] != x[:-1])]
            key = np.cumsum(new_a) - 1
            nth = np.cumsum(new) - 1
            starts = np.flatnonzero(new_a)
            nth -= nth[starts][key]  # contexts of the key before this one, in this batch
            carried = open_a is not None and a[0] == open_a
            if carried:
                nth[key == 0] += distinct - 1
            total = nth[np.r_[starts[1:], n] - 1] + 1  # of each key, so far
            e = p + c + length - 1
            kind = np.where(nth < many, 1, 2)
            shown = new & (total > 1)[key]
            repeats = ~new & ~_same_as_first(new, doc, row, p)
            if last is not None:
                shown[0] = False  # shown, or held back, before
            if carried and waiting is not None and total[0] > 1:
                yield _batch(names, np.ones(1, np.int64), *(np.array([v]) for v in waiting))
                waiting = None
            kind[repeats] = 0
            keep = shown | repeats
            if keep.any():
                yield _batch(names, *(v[keep] for v in (kind, a, doc, row, p, e)))
            tail = starts[-1]
            if not (carried and tail == 0):
                waiting = tuple(int(v[tail]) for v in (a, doc, row, p, e)) if total[-1] == 1 else None
            open_a, distinct = int(a[-1]), int(total[-1])
            at = int(np.flatnonzero(new)[-1])
            last = tuple(int(v[at]) for v in cols)

    return run


def _resolve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans (doc, row, s, e) to remove, from rows (a, doc, row, s, text) sorted by all but the last."""
        held: list = []
        n = 0

        def flush() -> pa.RecordBatch | None:
            index = RunLengthIndex([r[4] for r in held])
            late = np.flatnonzero(index.later(length))
            if not len(late):
                return None
            of = np.searchsorted(index.starts, late, "right") - 1
            first = np.r_[True, (np.diff(late) > 1) | (np.diff(of) > 0)]
            last = np.r_[first[1:], True]
            doc, row, s = (np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
            lo, hi = late[first], late[last]
            o = of[first]
            return _batch(["doc", "row", "s", "e"], doc[o], row[o], s[o] + lo - index.starts[o], s[o] + hi - index.starts[o] + length)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n > CHUNK and held[-1][0] != r[0]:
                    if (x := flush()) is not None:
                        yield x
                    held, n = [], 0
                held.append(r)
                n += len(r[4])
        if held and (x := flush()) is not None:
            yield x

    return run


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, a, doc, row, s, text) of the contexts listed with each text."""
    for b in batches:
        out = []
        for doc, row, text, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = text.encode()
            out += [(i["kind"], i["a"], doc, row, i["s"], raw[i["s"] : i["e"]]) for i in items]
        for i in range(0, len(out), 20_000):
            kind, a, doc, row, s, raw = zip(*out[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (kind, a, doc, row, s)), pa.array(raw, pa.binary())], ["kind", "a", "doc", "row", "s", "text"])


def _split(length: int, k: int, level: int):
    """Rows as of :func:`_extract` for the parts of contexts (doc, row, s, text): windows with the anchor in one of 2 ** level ranges of places.

    Windows that are equal have the anchor at the same place, so they are in parts of one range,
    which have in common all bytes that its windows share; a hash of these is the new key.
    """
    places = length - k + 1
    width = -(-places // (1 << level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, row, s, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q = int(_least(_anchor_hashes(raw[:length], k), places)[0])
                c = len(raw) - length + 1
                first = 0
                while first < c:  # windows from first on, with the anchor at place q - first
                    lo = (q - first) // width * width
                    hi = min(lo + width, places) - 1
                    end = min(c, q - lo + 1)
                    core = raw[q - lo : q - hi + length]
                    key = xxhash.xxh64_intdigest(core, 1 + lo)
                    out.append((key - (1 << 63), xxhash.xxh64_intdigest(raw[first : end + length - 1]) - (1 << 63), doc, row, s + first, end - first))
                    first = end
            if out:
                yield _batch(_ROW, *(np.array(v, np.int64) for v in zip(*out, strict=True)))

    return run


def repeated_spans(docs: DataFrame, length: int = 100, k: int = 32, many: int = MANY) -> DataFrame:
    """(doc, row, s, e): bytes s to e of documents to remove; spans may overlap.

    ``doc`` is the doc_id, the least long for a null one, ``row`` xxhash64 of the text. A span
    goes if each of its bytes is in a passage of ``length`` bytes that also starts earlier: in a
    document with a smaller id (null first), in one of equal id and smaller ``row``, or before in
    the same document. Rows that repeat both id and text count as one document. Contexts of an
    anchor with more than ``many`` of them are parted into several indexes by :func:`_split`, at
    most seven times; single windows, the last parts, are all settled by their hashes.
    """
    if not k <= length - 8:
        raise ValueError("the k-grams must be shorter than the passages")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = _keyed(docs).filter(F.octet_length("text") >= length)
    row = "a long, x long, doc long, row long, p long, c long"

    def settled(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(n, "a").sortWithinPartitions("a", "x", "doc", "row", "p")
        return settle(rows.mapInArrow(_settle_equal(length, many), "kind long, a long, doc long, row long, s long, e long"), "found", "kind")

    def texts(found: DataFrame) -> DataFrame:
        """The contexts of kinds 1 and 2 with their bytes; a key with any of kind 2 is hot as a whole."""
        hot = found.filter("kind = 2").select("a").distinct().withColumn("hot", F.lit(1))
        listed = found.filter("kind > 0").select("a", "doc", "row", "s", "e").join(hot, "a", "left").withColumn("kind", F.coalesce("hot", F.lit(0)).cast("long") + 1)
        items = settle(listed.groupBy("doc", "row").agg(F.collect_list(F.struct("kind", "a", "s", "e")).alias("items")), "items")
        text = d.join(items.toDF("doc_", "row_", "items"), (F.col("doc") == F.col("doc_")) & (F.col("row") == F.col("row_"))).dropDuplicates(["doc", "row"])
        out = settle(text.select("doc", "row", "text", "items").mapInArrow(_take, "kind long, a long, doc long, row long, s long, text binary"), "taken", "kind")
        forget(items)
        return out

    found = settled(d.mapInArrow(_extract(length, k), row))
    spans, few = [], []
    for level in range(1, (length - k).bit_length() + 2):
        spans.append(found.filter("kind = 0").select("doc", "row", "s", "e"))
        taken = texts(found)
        few.append(taken.filter("kind = 1").select("a", "doc", "row", "s", "text"))
        hot = taken.filter("kind = 2")
        if hot.isEmpty():
            break
        found = settled(hot.select("doc", "row", "s", "text").mapInArrow(_split(length, k, level), row))
    few = reduce(DataFrame.unionByName, few).repartition(n, "a").sortWithinPartitions("a", "doc", "row", "s")
    late = few.mapInArrow(_resolve(length), "doc long, row long, s long, e long")
    return reduce(DataFrame.unionByName, spans).unionByName(late)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def strip_repeats(docs: DataFrame, length: int = 100, k: int = 32, many: int = MANY, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) of every row of ``docs``.

    ``spans`` are the maximal removed runs of bytes as [start, end) pairs and ``kept`` the rest,
    binary since a cut may fall inside a character. Null texts count as empty, null ids come
    first in the order and stay null, repeated rows get equal results, an empty table gives no
    rows. See :func:`repeated_spans` for what is removed. Only doc_id and text are read.
    """
    spans = repeated_spans(docs, length, k, many).groupBy("doc", "row").agg(F.collect_list(F.array("s", "e")).alias("list"))
    spans = settle(spans, "spans").toDF("doc_", "row_", "list")
    src = _keyed(docs).join(spans, (F.col("doc") == F.col("doc_")) & (F.col("row") == F.col("row_")), "left").select("doc", "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw, merged = text.as_py().encode(), []
                for s, e in sorted(found or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                cuts = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((None if doc == _NO_ID else doc, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *((merged, kept) if with_kept else ())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    more = [("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())] if with_kept else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *more])
    text = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * with_kept
    return src.mapInArrow(run, text)
