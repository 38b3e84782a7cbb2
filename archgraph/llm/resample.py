"""Target-distribution importance resampling by a dictionary of distinct features (operator 12).

Features are runs of one word and of two. Their strings are counted over all texts, each distinct
string is hashed once into a bucket, and the buckets' counts give a gain for each bucket: the log
ratio of its smoothed frequency in the target and in the corpus. Gains (one for each of a fixed
number of buckets, broadcast) go back to the feature counts of documents. A Gumbel draw by the
hash of the id turns weights into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import forget, settle

#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit to a space; bytes of other characters stay.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Bytes of texts that are counted together in one task, and of texts for each shard of features, about.
CHUNK = 3 << 20


class _Numbers(dict):
    """word -> running number, by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Features:
    """Distinct words and pairs of neighbours of some texts, in the order of their bytes, and which of them each text holds."""

    def __init__(self, texts: list[bytes | None]) -> None:
        number = _Numbers()
        ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in ((t or b"").translate(_CLEAN).split() for t in texts)]
        self.n_words = np.array([len(x) for x in ids], np.int64)
        self.words = sorted(number)
        rank = np.empty(len(number), np.int64)
        rank[np.fromiter(map(number.__getitem__, self.words), np.int64, len(number))] = np.arange(len(number))
        self.tokens = rank[np.concatenate([np.empty(0, np.int64), *ids])]
        self.text = np.repeat(np.arange(len(texts)), self.n_words)
        inner = np.flatnonzero(self.text[1:] == self.text[:-1])
        pairs, self.of_pair = np.unique(self.tokens[inner] * max(len(number), 1) + self.tokens[inner + 1], return_inverse=True)
        self.first, self.second = np.divmod(pairs, max(len(number), 1))
        self.pair_text = self.text[inner]

    def strings(self) -> list[bytes]:
        """The distinct features: words, then pairs joined by a space."""
        w = self.words
        return w + [w[a] + b" " + w[b] for a, b in zip(self.first.tolist(), self.second.tolist(), strict=True)]

    def counts(self) -> np.ndarray:
        """How often each of :meth:`strings` occurs."""
        return np.concatenate([np.bincount(self.tokens, minlength=len(self.words)), np.bincount(self.of_pair, minlength=len(self.first))])

    def shards(self, n: int) -> np.ndarray:
        """A number below ``n`` for each of :meth:`strings`, by the words in it."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        both = h[self.first] * np.uint64(0x9E3779B97F4A7C15) + h[self.second]
        both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((np.concatenate([h, both]) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def total(self, gain: np.ndarray) -> np.ndarray:
        """Of each text the sum of ``gain``, given for :meth:`strings`, over its features."""
        k, sums = len(self.words), np.zeros(len(self.n_words), np.int64)
        for text, value in ((self.text, gain[:k][self.tokens]), (self.pair_text, gain[k:][self.of_pair])):
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            if len(heads):
                sums[text[heads]] += np.add.reduceat(value, heads)
        return sums


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches cut and put together to portions of about ``CHUNK`` bytes of text."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(ends, before + CHUNK - size, side="right"))))
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def feature_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(feature, n): how often each distinct feature occurs in all texts.

    A task counts some megabytes of texts at a time and deals the distinct strings, sorted and
    compressed together, to shards by a hash; a shard adds up its strings. No string is hot, since
    a task sends each one once.
    """
    spark = texts.sparkSession
    n = max(1, math.ceil((texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / CHUNK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(batches, 0):
            f = Features([t for b in some for t in b.column(0).to_pylist()])
            names, counts, shard = np.array(f.strings(), object), f.counts(), f.shards(n)
            order = np.argsort(shard, kind="stable")
            heads = np.flatnonzero(np.diff(shard[order], prepend=-1))  # of the shards that are there
            for s, mine in zip(shard[order[heads]].tolist(), np.split(order, heads[1:]) if len(heads) else [], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_packed(b"\n".join(names[mine].tolist()))], pa.binary()), pa.array([_packed(counts[mine].tobytes())], pa.binary())], ["shard", "features", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            parts = [pa.array(_unpacked(r[0]).split(b"\n"), pa.binary()) for r in rows]
            counts = pa.array(np.frombuffer(b"".join(_unpacked(r[1]) for r in rows), np.int64))
            total = pa.table({"feature": pa.chunked_array(parts), "n": counts}).group_by("feature", use_threads=False).aggregate([("n", "sum")])
            yield from total.rename_columns(["feature", "n"]).to_batches(max_chunksize=50_000)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(deal, "shard int, features binary, counts binary")
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(add, "feature binary, n long")


def _packed(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """(features, counts) of the rows of each shard."""
    held, last = [], None
    for b in batches:
        for s, f, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            if s != last and held:
                yield held
                held = []
            last = s
            held.append((f.as_py(), c.as_py()))
    if held:
        yield held


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): each distinct string is hashed once, to its CRC-32 modulo ``buckets``."""
    return features.groupBy((F.crc32("feature") % buckets).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed frequencies) of each bucket, target over documents; ``buckets`` longs."""
    spark = documents.sparkSession
    both = bucket_counts(feature_counts(documents), buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(feature_counts(target), buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row for each bucket
    total_s, total_t = sum(r["s"] for r in found), sum(r["t"] for r in found)
    counts = spark.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in found], "bucket int, s long, t long")
    d = lambda c: c.cast("double")
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    ratio = d(t + 1) * F.lit(float(total_s + buckets)) / (d(s + 1) * F.lit(float(total_t + buckets)))
    rows = spark.range(buckets).withColumn("bucket", F.col("id").cast("int")).join(counts, "bucket", "left").select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain")).collect()
    gain = np.zeros(buckets, np.int64)
    gain[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return gain


def document_weights(documents: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of gains over each text's features, 0 without any."""
    sent = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _chunks(batches, 1):
            f = Features([t for b in some for t in b.column(1).to_pylist()])
            names = f.strings()
            of = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % len(sent.value)
            n = np.maximum(2 * f.n_words - 1, 0)
            weight = f.total(sent.value[of]) // np.maximum(n, 1)
            ids = pa.chunked_array([b.column(0) for b in some]).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(f.n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    src = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str = "doc_id") -> Column:
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of sha256 of ``seed:id``; a null id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; the drawn ones have ranks 1, 2, 3, ...

    Of the N documents with at least ``least_words`` words, floor(``percent`` * N / 100) with the
    highest scores are drawn, ties to the smaller id, null ids last; repeated rows are rows of
    their own and stand in any order among each other. Null and empty texts have no features,
    weight 0 and are never drawn (if ``least_words`` > 0). Empty documents give no rows, an empty
    target gives gains from its smoothing alone. Ranks come from one range sort whose partitions
    are counted, not from a window over all rows. Only ``id_col`` and ``text`` are read.
    """
    weights = document_weights(documents, bucket_gains(documents, target, buckets), id_col)
    scored = settle(weights.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(seed)).alias("score"), (F.col("n_words") >= least_words).alias("fit")), "scored")
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    # the running number splits repeated rows over the ranges
    placed = settle(scored.withColumn("_row", F.monotonically_increasing_id()).orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    forget(scored)
    part = F.shiftright("at", 33).cast("int")
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("fit").cast("long")).alias("fit")).orderBy("p").collect()  # a row for each range
    before, starts = 0, []
    for r in sizes:
        starts.append((r["p"], before))
        before += r["n"]
    drawn = percent * sum(r["fit"] for r in sizes) // 100
    starts = F.broadcast(documents.sparkSession.createDataFrame(starts, "_p int, _start long"))
    place = F.col("_start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, part == F.col("_p")).select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
