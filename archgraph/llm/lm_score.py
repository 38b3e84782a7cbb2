"""Language-model scores of whole texts by sharded n-gram tries (operator 11).

The model mixes runs of three, two and one words: p(w | u v) = q3 + b3 (q2 + b2 p1) with the shares
q3 = c(u v w) / (c(u v) + L3), q2 = c(v w) / (c(v) + L2), the back-off weights b = L / (c + L) and
p1 = (c(w) + 1) / (N + V + 1); it sums to one over the known words and one unknown one.

Texts are cut into chunks of about a million tokens, written once with words as numbers. Counts of
words are merged in shards of word hashes, and each chunk gets back the number and count of its
words. Runs of three words are counted within a chunk, then dealt by their first word; a word that
starts very many runs is dealt by its first two words, such a pair by all three. A shard builds one
Elias-Fano trie of its training runs (:class:`~.ngram_trie.Trie`) and looks up in it the distinct
runs of every chunk; the codes of their shares go back to the chunk, which adds up its texts. No
task holds more than a chunk or a shard, whatever the size of the corpus or of one word's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import forget, release, settle
from .ngram_trie import Trie, quantise, shares

#: Tokens of a chunk, about, and of a shard; a word or pair that occurs more often is dealt to all shards.
CHUNK = 1 << 20
#: Weights of the lower orders, in tokens.
L2, L3 = 500.0, 4.0
#: Numbers of what is no known word: an unknown word, two marks of a text's begin, nothing.
UNKNOWN, BEGIN2, BEGIN1, NOTHING, FIRST = 0, 1, 2, 3, 4
#: Places looked up at a time.
PLACES = 1 << 17
_END = b" "  # no word holds a space


def pack(a: np.ndarray) -> bytes:
    """Longs as compressed byte planes."""
    a = np.ascontiguousarray(a, np.int64)
    return len(a).to_bytes(8, "little") + pa.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(b[8:], n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view(np.int64).reshape(n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of each hash, non-decreasing in the hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pair_hashes(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(_mix(u) ^ v.astype(np.uint64))


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values; the work is that of what is there, not of the shards there are."""
    heads = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return list(zip(sorted_[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(sorted_)], strict=True)) if len(heads) else []


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the place of each key among them, as np.unique has it with less memory."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    key = key[new]
    of = np.empty(len(order), np.int32)  # of a chunk or shard
    of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return key, of


def _sliced(find, *columns: np.ndarray) -> np.ndarray:
    """``find`` of slices of PLACES places each, so that what it holds on the way is bounded."""
    return np.concatenate([np.empty(0, np.int64), *(find(*(c[i : i + PLACES] for c in columns)) for i in range(0, len(columns[0]), PLACES))])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: col[i].as_py() for name, col in zip(b.schema.names, b.columns, strict=True)}


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each run of equal keys."""
    held: list[dict] = []
    for r in _rows(batches):
        if held and held[0][key] != r[key]:
            yield held[0][key], held
            held = []
        held.append(r)
    if held:
        yield held[0][key], held


def _gathered(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, keys[0]).sortWithinPartitions(*keys)


def chunks(docs: DataFrame, learn: Column, id_col: str, text_col: str, most: int = CHUNK) -> DataFrame:
    """(chunk, ids, n_words, n_learn, a, b, c, d): word hashes, training counts, tokens as places among the hashes, and of each text its tokens * 2 + learn."""
    src = docs.select(F.col(id_col).alias("k"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, task = 0, TaskContext.get().partitionId()
        ids, ints, learns, size, number = [], [], [], 0, _Numbers()

        def made() -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            order = np.argsort(h)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            n = np.array([len(x) for x in ints])
            tokens, known = rank[np.concatenate(ints)], np.array(learns)
            count = np.bincount(tokens[np.repeat(known, n)], minlength=len(h))
            cols = [pack(h[order].view(np.int64)), pack(count), pack(tokens), pack(n * 2 + known)]
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | seq]), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(ids)), pa.array([len(h)]), pa.array([int(n[known].sum())]), pa.array([int(n.sum())]), *(pa.array([c], pa.binary()) for c in cols)],
                ["chunk", "ids", "n_words", "n_learn", "n_tokens", "a", "b", "c", "d"])

        for b in batches:
            own = b.column(0).take(pa.array(range(b.num_rows), pa.int64()))  # a slice of the column itself holds the whole batch
            for i in range(b.num_rows):
                words = b.column(2)[i].as_py().lower().split()  # of bytes: A-Z and ASCII white space alone
                words.append(_END)
                ints.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                ids.append(own.slice(i, 1))
                learns.append(b.column(1)[i].as_py())
                size += len(words)
                if size >= most:
                    yield made()
                    seq += 1
                    ids, ints, learns, size, number = [], [], [], 0, _Numbers()
        if ids:
            yield made()

    return src.mapInArrow(run, f"chunk long, ids array<{src.schema['k'].dataType.simpleString()}>, n_words long, n_learn long, n_tokens long, a binary, b binary, c binary, d binary")


def word_counts(cut: DataFrame, n: int, most: int = CHUNK) -> DataFrame:
    """(chunk, part, a, b, tokens, words, hot): of each chunk and shard the numbers and training counts of the chunk's words, by hash.

    Known words have numbers from ``FIRST``. tokens, words and hot (words that occur more than
    ``most`` times) describe the shard and stand on one of its rows.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            h, count = unpack(r["a"]), unpack(r["b"])
            some = _runs(_shard(h.view(np.uint64), n))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, *_ in some], pa.int64()), pa.array([r["chunk"]] * len(some), pa.int64()), *(pa.array([pack(x[a:b]) for _, a, b in some], pa.binary()) for x in (h, count))], ["shard", "chunk", "h", "c"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard"):
            parts, counts = [unpack(r["h"]) for r in rows], np.concatenate([unpack(r["c"]) for r in rows])
            words, of = np.unique(np.concatenate(parts), return_inverse=True)
            count = np.bincount(of, counts, len(words)).astype(np.int64)
            known = count > 0
            number = np.where(known, FIRST + (np.cumsum(known) - 1) * n + shard, UNKNOWN)
            hot = [{"w": int(number[i]), "n": int(count[i])} for i in np.flatnonzero(count > most)]
            at = 0
            for i, (r, p) in enumerate(zip(rows, parts, strict=True)):
                mine = of[at : at + len(p)]
                at += len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["chunk"]]), pa.array([shard], pa.int64()), pa.array([pack(number[mine])], pa.binary()), pa.array([pack(count[mine])], pa.binary()), pa.array([0 if i else int(count.sum())]), pa.array([0 if i else int(known.sum())]), pa.array([[] if i else hot], pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))],
                    ["chunk", "part", "a", "b", "tokens", "words", "hot"])

    dealt = cut.select("chunk", "a", "b").mapInArrow(deal, "shard long, chunk long, h binary, c binary")
    return _gathered(dealt, "shard", "chunk").mapInArrow(merge, "chunk long, part long, a binary, b binary, tokens long, words long, hot array<struct<w:long,n:long>>")


def numbered(cut: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, ids, part, a, b, c, d) of each chunk: numbers and counts of its words, tokens as places among them, tokens * 2 + learn of its texts."""
    ids = cut.schema["ids"].dataType.simpleString()
    rows = cut.select("chunk", "ids", F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "c", "d")
    rows = rows.unionByName(words.select("chunk", F.lit(None).cast(ids).alias("ids"), "part", "a", "b", F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("ids").type
                yield b

        for chunk, rows in _grouped(seen(), "chunk"):
            own = rows[0]
            cols = [*(pack(np.concatenate([unpack(r[x]) for r in rows[1:]])) for x in "ab"), own["c"], own["d"]]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([own["ids"]], kind), pa.array([-1]), *(pa.array([c], pa.binary()) for c in cols)], ["chunk", "ids", "part", "a", "b", "c", "d"])

    return _gathered(rows, "chunk", "part").mapInArrow(run, f"chunk long, ids {ids}, part long, a binary, b binary, c binary, d binary")


class Windows:
    """The runs of three words of a chunk, distinct, with the pair that each starts with."""

    def __init__(self, number: np.ndarray, tokens: np.ndarray, texts: np.ndarray) -> None:
        n, learn = texts >> 1, (texts & 1).astype(bool)
        first = np.cumsum(n + 2) - (n + 2)
        own = np.append(np.array([UNKNOWN, BEGIN2, BEGIN1, NOTHING], np.int64), number)  # places of this chunk's words, after the marks
        seq = np.empty(int((n + 2).sum()), np.int32)
        inner = np.ones(len(seq), bool)
        seq[first], seq[first + 1], inner[first], inner[first + 1] = BEGIN2, BEGIN1, False, False
        seq[inner] = tokens + FIRST
        seq[own[seq] == UNKNOWN] = UNKNOWN
        self.seq, self.inner, self.first, self.n = seq, inner, first, n
        u, v, w = seq, np.append(seq[1:], np.int32(UNKNOWN)), np.append(seq[2:], np.full(min(2, len(seq)), NOTHING, np.int32))[: len(seq)]
        w[w == UNKNOWN] = NOTHING
        w[first + n] = NOTHING
        v[first + n + 1] = UNKNOWN  # what follows a text's end
        self.at = np.flatnonzero((u != UNKNOWN) & (v != UNKNOWN)).astype(np.int32)  # the rest has no context to look up
        pair, of = _distinct(u[self.at].astype(np.int64) << 32 | v[self.at])
        run, self.of = _distinct(of.astype(np.int64) << 32 | w[self.at])
        del of, v, w
        count = np.bincount(self.of, np.repeat(learn, n + 2)[self.at], len(run)).astype(np.int64)
        self.run_pair, self.w, self.count = (run >> 32).astype(np.int32), own[run & 0xFFFFFFFF], count
        self.u, self.v = own[pair >> 32], own[pair & 0xFFFFFFFF]

    def dealt(self, n: int, hot: dict[str, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, runs, pairs, runs of each pair), as places among the distinct ones."""
        shard = _shard(_mix(self.u), n)
        many = np.isin(self.u, hot["u"])
        both = pair_hashes(self.u, self.v)
        shard[many] = _shard(both[many], n)
        of = shard[self.run_pair]
        more = np.isin(both, hot["pair"])[self.run_pair]
        of[more] = _shard(_mix(both[self.run_pair[more]] ^ self.w[more].astype(np.uint64)), n)
        order = np.argsort(of, kind="stable")
        out = []
        for s, a, b in _runs(of[order]):
            runs = order[a:b]
            pairs, each = np.unique(self.run_pair[runs], return_counts=True)
            out.append((s, runs, pairs, each))
        return out


def _windows(r: dict) -> Windows:
    return Windows(unpack(r["a"]), unpack(r["c"]), unpack(r["d"]))


def hot_pairs(ready: DataFrame, hot: np.ndarray, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the pairs that start with one of the ``hot`` words and occur more than ``most`` times: at most tokens / most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            win = _windows(r)
            some = np.isin(win.u, hot)
            count = np.bincount(win.run_pair, win.count, len(win.u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(win.u[some], win.v[some]).view(np.int64)), pa.array(count[some])], ["pair", "n"])

    found = ready.select("a", "c", "d").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") > most).collect() if len(hot) else []
    pair, n = np.array([r["pair"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(pair)
    return pair[order], n[order]


def _shard_trie(u: np.ndarray, v: np.ndarray, pair: np.ndarray, w: np.ndarray, count: np.ndarray, hot: dict[str, np.ndarray]) -> bytes:
    """The trie of a shard's distinct pairs (u, v), sorted, and runs (pair, w), sorted, with training counts."""
    of_pair = np.bincount(pair, count, len(u)).astype(np.int64)
    heads = np.flatnonzero(np.diff(u, prepend=-1))
    total = np.add.reduceat(of_pair, heads) if len(u) else of_pair
    of_u = np.repeat(total, np.diff(np.append(heads, len(u))))
    at = np.searchsorted(hot["u"], u)
    far = np.isin(u, hot["u"])
    of_u[far] = hot["u_n"][at[far]]
    h = pair_hashes(u, v)
    far = np.isin(h, hot["pair"])
    whole = of_pair.copy()
    whole[far] = hot["pair_n"][np.searchsorted(hot["pair"], h[far])]
    run = (count > 0) & (w != NOTHING)
    share = count[run] / (whole[pair[run]] + L3)
    keep = whole > 0
    each = np.bincount(pair[run], minlength=len(u))
    return Trie.build(u[keep], v[keep], whole[keep] / (of_u[keep] + L2), L3 / (whole[keep] + L3), each[keep], w[run], share)


def look_up(ready: DataFrame, n: int, hot: dict[str, np.ndarray], with_tries: bool = False) -> DataFrame:
    """(chunk, part, a, b, c, trie): of each chunk and shard the codes of its pairs' shares and back-off weights and of its runs' shares.

    With ``with_tries`` one row of each shard carries its trie, the model that scores came from.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            win = _windows(r)
            parts = win.dealt(n, hot)
            cols = [[pack(win.u[p]) for _, _, p, _ in parts], [pack(win.v[p]) for _, _, p, _ in parts], [pack(e) for *_, e in parts], [pack(win.w[x]) for _, x, _, _ in parts], [pack(win.count[x]) for _, x, _, _ in parts]]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, *_ in parts], pa.int64()), pa.array([r["chunk"]] * len(parts), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["shard", "chunk", "u", "v", "n", "w", "c"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches, "shard"):
            sizes = [(int.from_bytes(r["u"][:8], "little"), int.from_bytes(r["w"][:8], "little")) for r in rows]
            chunk = [r["chunk"] for r in rows]
            column = lambda x, rows=rows: np.concatenate([unpack(r.pop(x)) for r in rows])
            first, of_u = _distinct(column("u"))
            pair, of_pair = _distinct(of_u.astype(np.int64) << 42 | column("v"))  # a shard has far fewer than 2^21 different first words
            run, of_run = _distinct(np.repeat(of_pair, column("n")).astype(np.uint64) << np.uint64(42) | column("w").view(np.uint64))
            at, word, count = (run >> np.uint64(42)).astype(np.int64), (run & np.uint64((1 << 42) - 1)).astype(np.int64), np.bincount(of_run, column("c"), len(run)).astype(np.int64)
            pu, pv = first[pair >> 42], pair & ((1 << 42) - 1)
            del run, pair, of_u
            made = _shard_trie(pu, pv, at, word, count, hot)
            trie = Trie(made)
            node = _sliced(trie.pair, pu, pv)
            there = node >= 0
            share, weight = quantise(np.zeros(len(pu))), quantise(np.ones(len(pu)))
            share[there], weight[there] = trie.pair_share[node[there]], trie.back_off[node[there]]
            del pu, pv, there, count
            leaf = _sliced(trie.triple, node[at], word)
            del at, node
            third = quantise(np.zeros(len(word)))
            third[leaf >= 0] = trie.triple_share[leaf[leaf >= 0]]
            p = q = 0
            for i, (np_, nw) in enumerate(sizes):
                mine, runs = of_pair[p : p + np_], of_run[q : q + nw]
                p, q = p + np_, q + nw
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk[i]]), pa.array([shard], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in (share[mine], weight[mine], third[runs])), pa.array([made if with_tries and not i else None], pa.binary())], ["chunk", "part", "a", "b", "c", "trie"])

    dealt = ready.select("chunk", "a", "c", "d").mapInArrow(deal, "shard long, chunk long, u binary, v binary, n binary, w binary, c binary")
    return _gathered(dealt, "shard", "chunk").mapInArrow(answer, "chunk long, part long, a binary, b binary, c binary, trie binary")


def _scores(ready: DataFrame, found: DataFrame, n: int, hot: dict[str, np.ndarray], tokens: int, words: int, texts: int) -> DataFrame:
    ids = ready.schema["ids"].dataType
    rows = ready.unionByName(found.select("chunk", F.lit(None).cast(ids).alias("ids"), "part", "a", "b", "c", F.lit(None).cast("binary").alias("d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("ids").type.value_type
                yield b

        for _, rows in _grouped(seen(), "chunk"):
            own, answers = rows[0], {r["part"]: r for r in rows[1:]}
            win, counts = _windows(own), np.append(np.zeros(FIRST, np.int64), unpack(own["b"]))
            del rows, own["a"], own["c"]
            q2, b3, q3 = np.zeros(len(win.u)), np.ones(len(win.u)), np.zeros(len(win.w))
            for s, runs, pairs, _ in win.dealt(n, hot):
                a = answers.pop(s)
                q2[pairs], b3[pairs], q3[runs] = shares(unpack(a["a"])), shares(unpack(a["b"])), shares(unpack(a["c"]))
            # of each place of the padded texts what the run that starts there says
            size = len(win.seq)
            third, weight, second = np.zeros(size), np.ones(size), np.zeros(size)
            third[win.at], weight[win.at], second[win.at] = q3[win.of], b3[win.run_pair[win.of]], q2[win.run_pair[win.of]]
            del q2, b3, q3, win.at, win.of, win.run_pair, win.u, win.v, win.w, win.count
            count = counts[win.seq]
            before = np.where(win.seq == BEGIN1, texts, count).astype(float)
            lower = L2 / (before + L2)
            del before
            here = np.flatnonzero(win.inner)
            base = (count[here] + 1) / (tokens + 1 * (words + 1))
            p = lower[here - 1] * base
            p += second[here - 1]
            p *= weight[here - 2]
            p += third[here - 2]
            del third, weight, second, lower
            heads = np.cumsum(win.n) - win.n
            yield pa.RecordBatch.from_arrays(
                [pa.array(own["ids"], kind), pa.array((unpack(own["d"]) & 1).astype(bool)), pa.array(win.n), pa.array(np.add.reduceat((count[here] > 0).astype(np.int64), heads)), pa.array(np.full(len(win.n), tokens)), pa.array(np.add.reduceat(np.log10(base), heads)), pa.array(np.add.reduceat(np.log10(p), heads))],
                ["k", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _gathered(rows, "chunk", "part").mapInArrow(run, f"k {ids.elementType.simpleString()}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows where ``learn`` holds (null: not) and scores all. Tokens are the
    words, with A-Z in lower case, and one end; a null or empty text is its end alone. base_score
    adds up log10 of p1, score log10 of p (see the module); n_known counts tokens that occur in
    training texts. Without training texts every word is unknown and p is 1. Repeated rows and ids
    are rows of their own, null ids stay null, an empty table gives no rows, other columns are not
    read. A text is held by one task, as is its row. All runs of words are counted and kept: no
    cut-off, no cap. Scores of equal texts are equal whatever the partitioning, up to rounding.
    ``chunk`` is the size of chunks and shards in tokens. With ``model``, a path, the tries are written there as (shard, trie), buffers that
    :meth:`Trie.map` reads.
    """
    cut = settle(chunks(docs, learn, id_col, text_col, chunk), "chunks")
    sums = cut.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    texts = cut.select("d").mapInArrow(_learned, "n long").agg(F.sum("n")).first()[0] or 0
    by_word = max(1, math.ceil((sums["w"] or 0) / chunk))
    words = settle(word_counts(cut, by_word, chunk), "words")
    total = words.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    often = [tuple(r["h"]) for r in words.select(F.explode("hot").alias("h")).collect()]  # at most tokens / chunk
    often = sorted(often + [(mark, texts) for mark in (BEGIN2, BEGIN1) if texts > chunk])
    hot = {"u": np.array([a for a, _ in often], np.int64), "u_n": np.array([b for _, b in often], np.int64)}
    ready = settle(numbered(cut, words), "numbered")
    forget(cut)
    forget(words)
    release(docs.sparkSession)
    hot["pair"], hot["pair_n"] = hot_pairs(ready, hot["u"], chunk)
    n = max(1, math.ceil((sums["t"] or 0) / chunk))
    found = settle(look_up(ready, n, hot, model is not None), "shares")
    release(docs.sparkSession)
    if model:
        found.filter("trie is not null").select(F.col("part").alias("shard"), "trie").write.mode("overwrite").parquet(model)
    return _scores(ready, found, n, hot, total["n"] or 0, total["v"] or 0, texts).withColumnRenamed("k", id_col)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int((unpack(x.as_py()) & 1).sum()) for x in b.column(0)], pa.int64())], ["n"])
