"""Quality classifier by supervised subword embeddings (operator 8).

A document is the average of learned vectors of its hashed features: each word, the character
n-grams of each word, and each pair of neighbouring words. A softmax layer turns the average
into class probabilities; vectors and layer are trained together by stochastic gradient descent
in numpy. As the layer is linear in the average, a fitted model is folded into one number per
bucket, and scoring needs sums of looked-up numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import give_back, kept
from .matrix_bpe import portions

_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: Words kept by a worker; a full table starts anew.
ENTRIES = 300_000


@dataclass(frozen=True)
class Config:
    """``max_rows`` and ``max_bytes`` bound the sample of labelled rows that the fit takes to the driver."""

    bits: int = 18
    dim: int = 12
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 4
    min_steps: int = 4000
    rate: float = 0.5
    max_rows: int = 6000
    max_bytes: int = 24_000_000
    seed: int = 7


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_features(words: list[str], config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets, word hashes): the buckets of word i are buckets[offsets[i] : offsets[i + 1]]."""
    raw = [b"<" + w.encode() + b">" for w in words]
    size = np.array([len(r) for r in raw])
    end = np.cumsum(size)
    start = end - size
    a = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(raw)), size)
    place = np.arange(len(a)) - start[of]
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    whole = np.add.reduceat(a * power[place], start)
    owner, hashes = [np.arange(len(raw))], [whole]
    h = a.copy()
    for n in range(2, max(config.grams) + 1):
        h = h[:-1] * _BASE + a[n - 1 :] if len(h) > 1 else h[:0]
        if n in config.grams:
            inside = np.flatnonzero(place[: len(h)] + n <= size[of[: len(h)]])
            owner.append(of[inside])
            hashes.append(h[inside] + np.uint64(n))
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return _bucket(hashes[order], config.bits), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(raw)))], whole


def pair_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of neighbouring words by the difference of their hashes, so that a word repeated is one feature."""
    return _bucket((hashes[1:] - hashes[:-1]) * _BASE + np.uint64(3), bits)


@dataclass
class Model:
    """A folded model: the logit of class 1 of each bucket."""

    config: Config
    logits: np.ndarray


def fit(texts: list[str], labels: list[int], config: Config = Config()) -> Model:
    """Train on whole texts. Without rows of both classes every bucket gets 0, so each score is 0.5."""
    size = 1 << config.bits
    if len(set(labels)) < 2:
        return Model(config, np.zeros(size))
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1 / config.dim, 1 / config.dim, (size, config.dim)).astype(np.float32)
    layer = np.zeros((config.dim, 2), np.float32)
    docs = []
    for text in texts:
        words = text.split()
        if not words:
            docs.append((np.empty(0, np.int64), np.empty(0, np.float32)))
            continue
        distinct, at = np.unique(np.array(words, object), return_inverse=True)
        buckets, offsets, hashes = word_features(distinct.tolist(), config)
        times = np.repeat(np.bincount(at), np.diff(offsets))
        pairs = pair_buckets(hashes[at], config.bits)
        ids, where = np.unique(np.r_[buckets, pairs], return_inverse=True)
        n = np.bincount(where, weights=np.r_[times, np.ones(len(pairs))])
        docs.append((ids, (n / n.sum()).astype(np.float32)))
    epochs = max(config.epochs, -(-config.min_steps // len(docs)))  # a small sample is gone through more often
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate = np.float32(config.rate * (1 - step / steps))
            step += 1
            ids, weight = docs[i]
            if not len(ids):
                continue
            v = vectors[ids]
            hidden = weight @ v
            z = hidden @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            vectors[ids] = v - (rate * len(ids) ** 0.5) * np.outer(weight, back)
    return Model(config, (vectors.astype(np.float64) @ (layer[:, 1] - layer[:, 0]).astype(np.float64)))


class Scorer:
    """Scores of whole texts, with a table of words of bounded size."""

    def __init__(self, model: Model) -> None:
        self.model, self.row = model, {}
        self._reset()

    def _reset(self) -> None:
        self.row.clear()
        self.sum, self.count, self.hash = np.empty(0), np.empty(0), np.empty(0, np.uint64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [s.split() for s in texts]
        if len(self.row) > ENTRIES:
            self._reset()
        new = [w for w in set(chain.from_iterable(words)) if w not in self.row]
        logits, config = self.model.logits, self.model.config
        if new:
            buckets, offsets, hashes = word_features(new, config)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.sum = np.r_[self.sum, np.add.reduceat(logits[buckets], offsets[:-1])]
            self.count = np.r_[self.count, np.diff(offsets)]
            self.hash = np.r_[self.hash, hashes]
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        at = np.fromiter(map(self.row.__getitem__, chain.from_iterable(words)), np.int64, int(end[-1]) if len(end) else 0)
        pair = np.zeros(len(at))
        if len(at) > 1:
            pair[1:] = logits[pair_buckets(self.hash[at], config.bits)]
            pair[(end - size)[(size > 0) & (end - size < len(at))]] = 0  # the first word of a text has none before it
        total = np.r_[0.0, np.cumsum(self.sum[at] + pair)]
        n = np.r_[0.0, np.cumsum(self.count[at] + 1)]
        total, n = total[end] - total[end - size], n[end] - n[end - size] - (size > 0)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1), -500, 500)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that a fit may not see: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, config: Config = Config(), label: str = "quality") -> Model:
    """Fit on the labelled rows that are not held out, at most ``config.max_rows`` rows and ``config.max_bytes`` bytes.

    The sample is taken by the order of a hash of the id, in whole texts; a text that does not fit is passed over. Rows with a null id or
    label are not used; of an id with several labels the largest counts, of one with several
    texts the least. Without labelled rows every score is 0.5. What the fit took of the driver's memory is given back.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_rows)  # as many rows at any size
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = d.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sizes = sorted(rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("text").alias("n")).collect())
    total, ids = 0, []
    for _, doc_id, n in sizes:
        if total + n > config.max_bytes:
            continue
        total += n
        ids.append(doc_id)
    got: list = []
    if ids:
        chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema)
        got = sorted(rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "y").collect())
    model = fit([r["text"] for r in got], [min(1, max(0, r["y"])) for r in got], config)
    del got
    give_back()  # the driver goes on with other work
    return model


#: Texts that are Python strings at a time.
ROWS = 1024


def _score(shared, column: pa.Array) -> np.ndarray:
    """Scores with the tables of this process, which serves one model at a time."""
    scorer, out = kept(("quality", shared), lambda: Scorer(shared.value)), [np.empty(0)]
    for i in range(0, len(column), ROWS):
        texts = [s or "" for s in column.slice(i, ROWS).to_pylist()]
        out += [scorer(texts[part]) for part in portions(texts)]
    return np.concatenate(out)


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A text without words scores 0.5, null texts count as empty; a null id is not held out.
    Repeated rows are each scored. Only doc_id and text are read. One narrow pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_score(shared, b.column(1)), pa.float64())], ["doc_id", "score"])

    src = docs.select("doc_id", "text")
    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are. Needs a column text."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_score(shared, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
