"""SimHash near-duplicates by anchor-point covering (operator 4).

Fingerprints of 64 bits within a threshold are found by anchors: the bits are parted into
23 + 23 + 18. For a block of 23 bits the anchors are the words of the binary Golay code, whose
covering radius is 3 and which is perfect, so each value has one home anchor within 3. Two
fingerprints with at most 4 differing bits have at most 1 of them in one of the long blocks or
none in the short one (2 + 2 use up all four). So each fingerprint goes to its home anchor and,
as a visitor, to every anchor within 3 + 1 of its block: these are all anchors within covering
radius plus the block's share of the threshold, 5.3 on average. For the short block each value is
an anchor of radius 0. Visitors are compared with the homes of each anchor in whole 64 bits.
With shares of s bits for the long blocks and s - 1 for the short one, thresholds up to 3 s + 1
are covered; s = 2 sends 63 copies of a fingerprint, s = 1 sends 12.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import components, forget, in_cells, segments, settle, spanning_labels

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
_BLOCKS = ((0, 23), (23, 23), (46, 18))


@lru_cache
def golay(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each value of 23 bits, error patterns of weight <= ``radius`` by syndrome, lightest first, -1 where there are fewer)."""
    syndrome = np.arange(1 << 23, dtype=np.int32)
    for i in range(22, 10, -1):
        syndrome ^= (syndrome >> i & 1) * np.int32(GOLAY << (i - 11))
    by: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(radius + 1):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            by[syndrome[e]].append(e)
    patterns = np.full((1 << 11, max(map(len, by))), -1, np.int32)
    for s, es in enumerate(by):
        patterns[s, : len(es)] = es
    return syndrome.astype(np.int16), patterns


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, each set if it is set in over half of the XXH64 values (seed 42) of the shingles.

    Shingles are runs of ``words`` words of the text with A-Z lower-cased, repeats included;
    of fewer words the whole sequence is the one shingle; without words the value is 0.
    """
    w = (text or "").encode().lower().split()  # both for ASCII only, as the contract has it
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row: :func:`fingerprint` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(s, words) for s in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _anchored(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, anchor, home, fp): each fingerprint at its home anchors and, as a visitor, at all near ones."""
        syndrome, patterns = golay(3 + share)
        flips = [sum(1 << p for p in c) for w in range(share) for c in combinations(range(18), w)]
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = []
            for block, (shift, width) in enumerate(_BLOCKS):
                x = (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int32)
                if width == 23:
                    e = patterns[syndrome[x]]
                    rows.append((block, x ^ e[:, 0], 1, fp))
                    for c in e.T:
                        has = c >= 0
                        rows.append((block, (x ^ c)[has], 0, fp[has]))
                else:
                    rows.append((block, x, 1, fp))
                    rows += [(block, x ^ np.int32(f), 0, fp) for f in flips]
            n = [len(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([r[0] for r in rows], n).astype(np.int64)), pa.array(np.concatenate([r[1] for r in rows]).astype(np.int64)), pa.array(np.repeat([r[2] for r in rows], n).astype(np.int64)), pa.array(np.concatenate([r[3] for r in rows]).view(np.int64))],
                ["block", "anchor", "home", "fp"])

    return run


def _linked(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links of each cell, at most one edge for each of its rows."""
        for _, (home, fp) in segments(batches, 3):
            h, v = fp[home == 1], fp[home == 0]
            if not len(h) or not len(v) or len(h) == len(v) == 1 and h[0] == v[0]:
                continue
            near = np.bitwise_count(v.view(np.uint64)[:, None] ^ h.view(np.uint64)[None, :]) <= threshold
            label_v, label_h = spanning_labels(near)
            linked = near.any(1)
            a, b = np.r_[v[linked], h], h[np.r_[label_v[linked], label_h]]
            real = a != b
            if real.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real])], ["u", "v"])

    return run


def fingerprint_components(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """(node, component_id) of the fingerprints of ``fps(fp)``, distinct, that link with another one."""
    if not 0 <= threshold <= 10:
        raise ValueError("the anchors cover thresholds up to 10")
    rows = fps.select("fp").mapInArrow(_anchored(max(1, (threshold + 1) // 3)), "block long, anchor long, home long, fp long")
    edges = in_cells(rows, ["block", "anchor"], ["fp"]).mapInArrow(_linked(threshold), "u long, v long")
    return components(edges)


def simhash_components(docs: DataFrame, threshold: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``threshold`` differing bits reach,
    the row's own included. Null texts and texts without words have fingerprint zero and link like
    any other. A row with a null doc_id gets the smallest id of its component, null if it has none
    with an id. Repeated rows fall together; an empty table gives no rows; only doc_id and text
    are read. Equal fingerprints are merged before any comparison, by partial aggregation.
    """
    rows = settle(fingerprints(docs, words), "fps")
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = fingerprint_components(fps, threshold).toDF("fp", "root")
    member = settle(fps.join(nodes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    roots = settle(member.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    by_fp = settle(member.join(roots, "root").select("fp", "component_id"), "by-fp")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = 4, words: int = 5) -> DataFrame:
    """One row of ``docs`` of each component of :func:`simhash_components`, all columns as they are.

    The row with the smallest doc_id stays; of several with that id, and in a component without
    any id, the one with the least hash of its text, and one of rows that agree in that too.
    Documents are picked by small rows; texts are shuffled only to be joined with them.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)  # names that can't clash, whatever the columns of docs are called
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    marked = settle(d.withColumn("_row", F.monotonically_increasing_id()), "marked")
    key = marked.select(F.col("_row").alias("doc_id"), text.alias("text"))
    rows = settle(fingerprints(key, words), "fps").toDF("_row", "fp")
    rows = settle(rows.join(marked.select("_row", doc_id.alias("id"), F.xxhash64(text).alias("h")), "_row"), "keys")
    # of each fingerprint its best row; null ids last, so that they stay only where there is no other
    best = F.struct(F.col("id").isNull(), "id", "h", "_row")
    fps = settle(rows.groupBy("fp").agg(F.min(best).alias("best")), "distinct")
    nodes = fingerprint_components(fps, threshold).toDF("fp", "root")
    kept = fps.join(nodes, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    kept = settle(kept.select(F.col("best._row").alias("_row")), "kept")
    return marked.join(kept, "_row", "left_semi").select(*names).toDF(*docs.columns)


#: A wide SimHash has WIDE blocks of 23 bits in WORDS longs; two of these are compared as a whole.
WIDE, WORDS = 8, 3
_DRAWS = np.random.default_rng(7).integers(0, 1 << 64, (2, WORDS), np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """XXH64 values (seed 42) of the set of shingles, sorted; words and short texts as in :func:`fingerprint`."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in runs), np.uint64))


def wide_simhash(h: np.ndarray) -> np.ndarray:
    """WORDS longs of bits, each set if it is set in over half of as many mixes of the hashes of a set; zero for an empty set."""
    votes = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 1 << 14):
        x = (h[i : i + (1 << 14), None] ^ _DRAWS[0]) * (_DRAWS[1] | np.uint64(1))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        votes += np.unpackbits(np.ascontiguousarray(x ^ (x >> np.uint64(32))).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)


def _wide_anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, home, node, w0, w1, grp) of batches (node, w0, w1, w2, grp): for each block the home anchor and, as a visitor, all anchors within 3 + 2."""
    syndrome, patterns = golay(5)
    for batch in batches:
        for i in range(0, len(batch), 2000):
            node, *words, grp = (c.to_numpy(zero_copy_only=False) for c in batch.slice(i, 2000).columns)
            bits = np.unpackbits(np.ascontiguousarray(np.stack(words, 1)).view(np.uint8).reshape(len(node), -1), axis=1, bitorder="little")
            out = []
            for block in range(WIDE):
                x = bits[:, 23 * block : 23 * block + 23].astype(np.int32) @ (1 << np.arange(23, dtype=np.int32))
                e = patterns[syndrome[x]]
                near = e >= 0
                who = np.repeat(np.arange(len(x)), near.sum(1))
                out.append((np.r_[x ^ e[:, 0], (x[:, None] ^ e)[near]].astype(np.int64) | block << 23, np.r_[np.ones(len(x), np.int64), np.zeros(len(who), np.int64)], np.r_[np.arange(len(x)), who]))
            key, home, who = (np.concatenate(c) for c in zip(*out, strict=True))
            cols = [key, home, node[who], words[0][who], words[1][who], grp[who]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "home", "node", "w0", "w1", "grp"])


def _wide_pairs(radius: int, stars: bool):
    """Of each cell pairs (u, v) within ``radius`` of 128 bits: a spanning forest of stars, or all those in different groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (home, node, w0, w1, grp) in segments(batches, 2):
            h, v = home == 1, home == 0
            if not h.any() or not v.any():
                continue
            near = np.bitwise_count(w0[v].view(np.uint64)[:, None] ^ w0[h].view(np.uint64)[None, :])
            near = near + np.bitwise_count(w1[v].view(np.uint64)[:, None] ^ w1[h].view(np.uint64)[None, :]) <= radius
            a, b = node[v], node[h]
            if stars:
                label, label_h = spanning_labels(near)
                linked = near.any(1)
                x, y = np.r_[a[linked], b], b[np.r_[label[linked], label_h]]
            else:
                i, j = np.nonzero(near & (grp[v][:, None] != grp[h][None, :]))
                x, y = a[i], b[j]
            real = x != y
            if real.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[real]), pa.array(np.maximum(x, y)[real])], ["u", "v"])

    return run


def keep_similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 32) -> DataFrame:
    """One row of ``docs`` of each group that links of shingle similarity connect, all columns as they are.

    Documents link if their sets of shingles of ``words`` words have a Jaccard similarity of
    ``similarity`` or more, verified on the whole sets. Candidates come from a SimHash of the set:
    they meet at an anchor of the Golay code in one of eight blocks of 23 bits, where each goes to
    its home anchor and visits all within covering radius 3 plus 2, and differ in at most
    ``radius`` of 128 bits. A pair of similarity 0.8 differs in 15 % of the bits, so that it
    meets in one block with a chance of 0.30 and in some block with 0.94; at 0.9 with 0.999.

    In each cell every document is verified with one centre of its links first; where that leaves
    the documents of a SimHash component in several groups, all candidates between these groups
    are verified too. Of a group the row with the smallest doc_id stays; of several with that id,
    and in a group without any id, the one with the least hash of its text, and one of rows that
    agree in that too. Texts with equal sets, also empty ones, link; null texts count as empty.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)  # names that can't clash, whatever the columns of docs are called
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    marked = settle(d.withColumn("_row", F.monotonically_increasing_id()), "marked")
    w = [f"w{i}" for i in range(WORDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(s, words) for s in b.column(1).to_pylist()]
            sig = [xxhash.xxh3_128_hexdigest(h.tobytes()) for h in sets]
            fp = np.array([wide_simhash(h) for h in sets], np.uint64).reshape(len(sets), WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["_row", "sig", "n", *w])

    seen = settle(marked.select("_row", text.alias("t")).mapInArrow(describe, "_row long, sig string, n long, " + ", ".join(f"{c} long" for c in w)), "described")
    keys = marked.select("_row", doc_id.alias("id"), F.xxhash64(text).alias("h"))
    # of each set its best row; null ids last, so that they stay only where there is no other
    best = F.struct(F.col("id").isNull(), "id", "h", "_row")
    distinct = settle(seen.join(keys, "_row").groupBy("sig").agg(F.min(best).alias("best"), F.min("_row").alias("node"), *[F.first(c).alias(c) for c in ("n", *w)]), "distinct")

    def pairs(nodes: DataFrame, stars: bool, name: str) -> DataFrame:
        """Candidates among nodes(node, w.., grp) whose sizes allow the similarity."""
        rows = nodes.select("node", *w, "grp").mapInArrow(_wide_anchored, "key long, home long, node long, w0 long, w1 long, grp long")
        return settle(in_cells(rows, ["key"], ["node", "w0", "w1", "grp"]).mapInArrow(_wide_pairs(radius, stars), "u long, v long").distinct(), name)

    def verified(found: DataFrame, name: str) -> DataFrame:
        wanted = found.select(F.col("u").alias("_row")).unionByName(found.select(F.col("v").alias("_row"))).distinct()

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, len(b), 500):
                    part = b.slice(i, 500)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(s, words).view(np.int64) for s in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["_row", "set"])

        own = settle(marked.select("_row", text.alias("t")).join(wanted, "_row").mapInArrow(sets, "_row long, set array<long>"), "sets")
        t = found.join(own.toDF("u", "a"), "u").join(own.toDF("v", "b"), "v")
        least, most = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
        both = F.size(F.array_intersect("a", "b"))
        out = settle(t.filter(least >= most * F.lit(similarity) - 1e-9).filter(both >= (least + most - both) * F.lit(similarity) - 1e-9).select("u", "v"), name)
        forget(own)
        return out

    nodes = distinct.select("node", *w, F.col("node").alias("grp"))
    stars = pairs(nodes, True, "stars")
    edges = verified(stars, "edges")
    groups = settle(components(edges).toDF("node", "grp"), "groups")
    # SimHash components that the verified links leave in several groups
    apart = settle(components(stars).toDF("node", "part").join(groups, "node", "left").select("node", "part", F.coalesce("grp", "node").alias("grp")), "apart")
    open_ = apart.groupBy("part").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low < high").select("part")
    left = apart.join(open_, "part").select("node", "grp").join(distinct.select("node", *w), "node")
    rest = pairs(left, False, "rest")
    if not rest.isEmpty():
        groups = settle(components(edges.unionByName(verified(rest, "extra"))).toDF("node", "grp"), "groups")
    named = distinct.join(groups, "node", "left").select("best", F.coalesce("grp", "node").alias("grp"))
    kept = settle(named.groupBy("grp").agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row")), "kept")
    for t in (seen, distinct, stars, edges, groups, apart, rest):
        forget(t)
    return marked.join(kept, "_row", "left_semi").select(*names).toDF(*docs.columns)
