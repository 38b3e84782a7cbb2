"""Document fingerprints: weighted SimHash and permuted block tables (operator 5).

The terms of a text are its words, each with its number of occurrences as weight. Each term's
hash votes on 64 signed bits with that weight; the signs are the fingerprint. All fingerprints
within a Hamming radius r are found by r + 1 tables, each keyed by another block of the permuted
bits: of two fingerprints that differ in r bits one block at least is equal.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import in_cells, kept, segments, settle
from .matrix_bpe import portions

#: Terms kept by a worker with their votes; a full table starts anew.
ENTRIES = 200_000


class Voter:
    """Fingerprints of texts, with a bounded table of the votes of terms."""

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.row = seed, {}
        self.votes = np.empty((ENTRIES * 2, 64), np.int8)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = [np.empty(0, np.uint64), *(self._some(texts[part]) for part in portions(texts, 400_000))]
        return np.concatenate(out)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > ENTRIES:
            self.row.clear()
            new = list(words)
        if len(new) > len(self.votes):
            self.votes = np.empty((len(new), 64), np.int8)
        at = len(self.row)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), self.seed) for w in new), np.uint64, len(new))
        self.votes[at : at + len(new)] = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int8) * 2 - 1

    def _some(self, texts: list[str]) -> np.ndarray:
        words = [s.split() for s in texts]
        self._learn(set(chain.from_iterable(words)))
        get, out = self.row.__getitem__, np.zeros(len(texts), np.uint64)
        for i, w in enumerate(words):
            if w:
                at = np.fromiter(map(get, w), np.int64, len(w))
                total = np.zeros(64, np.int64)
                for j in range(0, len(at), 1 << 15):
                    total += self.votes[at[j : j + (1 << 15)]].sum(0, dtype=np.int64)
                out[i] = np.packbits(total > 0, bitorder="little").view(np.uint64)[0]
        return out


def _voter(seed: int) -> Voter:
    return kept(("voter", seed), lambda: Voter(seed))


def fingerprints(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed long; null texts and texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _voter(seed)([s or "" for s in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["k", "fp"])

    src = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, fp long").withColumnRenamed("k", id_col)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_counts(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, n_near): of each fingerprint of ``fps(fp, n)``, distinct, how many of the n rows of others lie within ``radius`` bits.

    ``radius`` + 1 block tables; a pair that several tables hold is counted by the first one.
    Values that no other one is near are left out. Buckets of any size are compared in cells.
    """
    tables, cuts = radius + 1, [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [((1 << cuts[t + 1]) - (1 << cuts[t])) for t in range(tables)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for t in range(tables):
                # the permutation brings block t to the front; as a key the block alone is enough
                key = ((fp.view(np.uint64) & np.uint64(masks[t])) >> np.uint64(cuts[t])).astype(np.int64)
                for home in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t)), pa.array(key), pa.array(np.full(len(fp), home)), pa.array(fp), pa.array(n)], ["t", "key", "home", "fp", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, *_), (home, fp, n) in segments(batches, 3):
            h, v = fp[home == 1].view(np.uint64), fp[home == 0].view(np.uint64)
            if not len(h) or not len(v) or len(h) == len(v) == 1 and h[0] == v[0]:
                continue
            x = h[:, None] ^ v[None, :]
            near = (np.bitwise_count(x) <= radius) & (x != 0)
            for m in masks[: int(t)]:
                near &= (x & np.uint64(m)) != 0
            total = near @ n[home == 0]
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[total > 0].view(np.int64)), pa.array(total[total > 0])], ["fp", "n_near"])

    rows = fps.select("fp", "n").mapInArrow(blocks, "t long, key long, home long, fp long, n long")
    cells = in_cells(rows, ["t", "key"], ["fp", "n"])
    return cells.mapInArrow(count, "fp long, n_near long").groupBy("fp").agg(F.sum("n_near").alias("n_near"))


def _bucket(before: list[Column]) -> Column:
    """Number of bounds that stand before a row, by a balanced tree; ``before`` tells of each bound, in order, whether the row is before it."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(before[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(before))


def _bounds(d: DataFrame, n: int) -> list[Column]:
    """At most about 4 n bounds of rows d(doc_id, h) with a further hash r, ordered by descending doc_id, h and r, nulls last; each as whether a row is before it.

    An id that holds a share of 1/n or more of the rows, null too, is cut by ranges of h, and rows that
    agree in id and h, of as large a share, by ranges of r. h and r are hashes, so ranges of equal width serve.
    """
    total, nulls = d.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    found = d.select("doc_id").filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    times = Counter(int(x) for x in found)
    parts: dict[int | None, int] = {v: m + 1 for v, m in times.items() if m > 1}
    if n > 1 and nulls * n >= total > 0:
        parts[None] = -(-nulls * n // total)
    pairs: dict[int | None, dict[int, int]] = {}
    if parts:
        hot = F.col("doc_id").isin([v for v in parts if v is not None]) | (F.col("doc_id").isNull() if None in parts else F.lit(False))
        for r in d.filter(hot).groupBy("doc_id", "h").count().filter(F.col("count") * n >= total).collect():  # at most n rows
            pairs.setdefault(r["doc_id"], {})[r["h"]] = -(-r["count"] * n // total)
    cuts = lambda m: [(1 << 63) - 1 - (i << 64) // m for i in range(1, m)]
    id_, h, r = F.col("doc_id"), F.col("h"), F.col("r")
    out: list[Column] = []
    for v in sorted(times.keys() | parts.keys(), key=lambda v: (v is None, -(v or 0))):
        first, same = (id_.isNotNull(), id_.isNull()) if v is None else (F.coalesce(id_ > v, F.lit(False)), id_.eqNullSafe(F.lit(v)))
        if v in parts:
            out.append(first)
            inner = [((x, 1), h >= x) for x in cuts(parts[v])]
            for x, m in pairs.get(v, {}).items():
                inner.append(((x, 2), h > x))
                inner += [((x, 1 + (y + (1 << 63) + 1) / (1 << 65)), (h > x) | ((h == x) & (r >= y))) for y in cuts(m)]
                inner.append(((x, 1), h >= x))
            out += [first | (same & c) for _, c in sorted(inner, key=lambda i: i[0], reverse=True)]
        if v is not None:
            out.append(first | same)
    return out


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (b, look, doc_id, h, text), partitioned by bucket b and sorted, so that the row after each row is its next document.

    Documents stand by descending doc_id, null ids last, ties by a hash of the text, descending;
    after the last comes the first. ``look`` = 1 marks a copy of the first row of the following
    bucket at a bucket's end; where that row is repeated, its copies come along. doc_id must be a
    number of whole value. Bounds come from approximate quantiles, so ids may be of any spread, and
    ids or rows that repeat are parted too (:func:`_bounds`); the driver holds one row for each bucket.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    bounds = _bounds(d.select("doc_id", "h"), n)
    d = d.withColumn("r", F.xxhash64(F.monotonically_increasing_id())).withColumn("b", _bucket(bounds)).drop("r")
    # the first row of a bucket: the largest id, a null being less than any
    first = sorted((r["b"], r["f"]) for r in d.groupBy("b").agg(F.max(F.struct("doc_id", "h")).alias("f")).collect())
    if not first:
        return d.select("b", F.lit(0).alias("look"), "doc_id", "h", "text")
    ends = [(first[i][0], f["doc_id"], f["h"], first[i - 1][0]) for i, (_, f) in enumerate(first)]
    heads = F.broadcast(spark.createDataFrame(ends, f"b int, first_id {docs.schema['doc_id'].dataType.simpleString()}, first_h long, before int"))  # a row for each bucket
    head = F.col("first_id").eqNullSafe(F.col("doc_id")) & (F.col("first_h") == F.col("h"))
    here, there = F.struct("b", F.lit(0).alias("look")), F.struct(F.col("before").alias("b"), F.lit(1).alias("look"))
    out = d.join(heads, "b").withColumn("to", F.explode(F.when(head, F.array(here, there)).otherwise(F.array(here))))
    out = out.select("to.b", "to.look", "doc_id", "h", "text")
    return out.repartitionById(len(bounds) + 1, "b").sortWithinPartitions("b", "look", F.col("doc_id").desc_nulls_last(), F.col("h").desc())


def edited_fingerprints(docs: DataFrame, seed: int = 0, radius: int = 3) -> DataFrame:
    """Fingerprints of every row's text, of its edited text and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document (:func:`with_next`). Returns doc_id, n_chars, edited_sha256,
    fingerprint and edited_fingerprint (16 hex digits), near_edited and near_next (likeness to
    the edited and the next text's fingerprint), n_near: other rows with a fingerprint within
    ``radius`` bits. Null texts count as empty; a table of one row is its own next document;
    repeated rows follow each other; an empty table gives no rows. Texts are shuffled once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote, held = _voter(seed), None
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), b.column(2), strict=True))
            for part in portions([r[2] for r in rows], 2_000_000):
                some = rows[part]
                fps = vote([r[2] for r in some]).tolist()
                done = []
                for r, fp in zip(some, fps, strict=True):
                    if held and held[0][0] == r[0] and held[0][1] == 0:
                        done.append((*held, r, fp))
                    held = (r, fp)
                if not done:
                    continue
                edited = [own[2][: len(own[2]) - len(own[2]) // 2] + nxt[2][: len(own[2]) // 2] for own, _, nxt, _ in done]
                own_fp, edit_fp, next_fp = np.array([d[1] for d in done], np.uint64), vote(edited), np.array([d[3] for d in done], np.uint64)
                like = lambda x: pa.array(1 - np.bitwise_count(own_fp ^ x) / 64)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0][3].as_py() for d in done], b.schema.field(2).type), pa.array([len(d[0][2]) for d in done], pa.int64()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in edited]), pa.array(own_fp.view(np.int64)), pa.array(edit_fp.view(np.int64)), like(edit_fp), like(next_fp)],
                    ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"])

    rows = with_next(docs).select("b", "look", "doc_id", "text")
    out = settle(rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"), "edited")
    fps = settle(out.groupBy("fp").agg(F.count("*").alias("n")), "fps")
    near = settle(fps.join(near_counts(fps, radius), "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near")), "near")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.join(near, "fp").select("doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
