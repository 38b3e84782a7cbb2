"""Language-model scores against plain counters, and the trie against sets."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from archgraph.llm.lm_score import FIRST, L2, L3, Windows, pack, score_texts, unpack
from archgraph.llm.ngram_trie import EliasFano, Trie, quantise, shares

SCHEMA = "doc_id long, text string, part long, k string, a binary, learned int"


def words(text):
    return (text or "").encode().lower().split()


def brute(docs, learns):
    """(id, learned, n_tokens, n_known, N, base, score) by dictionaries, in full precision."""
    uni, pairs, triples, starts = Counter(), Counter(), Counter(), Counter()
    for (_, t), keep in zip(docs, learns):
        if keep:
            seq = [1, 2, *words(t), 0]
            uni.update(seq[2:])
            starts.update(seq[1:-1])
            pairs.update(zip(seq, seq[1:]))
            triples.update(zip(seq, seq[1:], seq[2:]))
    N, V = sum(uni.values()), len(uni)
    out = []
    for (i, t), keep in zip(docs, learns):
        seq = [1, 2, *words(t), 0]
        base = score = known = 0
        for u, v, w in zip(seq, seq[1:], seq[2:]):
            p1 = (uni[w] + 1) / (N + V + 1)
            p2 = (pairs[v, w] + L2 * p1) / (starts[v] + L2)
            p3 = (triples[u, v, w] + L3 * p2) / (pairs[u, v] + L3)
            known += uni[w] > 0
            base += math.log10(p1)
            score += math.log10(p3)
        out.append((i, keep, len(seq) - 2, known, N, base, score))
    return sorted(out, key=repr)


def run(spark, docs, parts=3, learn=None, **options):
    df = spark.createDataFrame([(i, t, 1, "x", b"", 0) for i, t in docs], SCHEMA).repartition(parts)
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2 if learn is None else learn
    return sorted((tuple(r) for r in score_texts(df, learn, **options).collect()), key=repr)


def same(got, docs):
    want = brute(docs, [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in docs])
    key = lambda r: repr(r[:6])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (repr(r[:5]), r[5])), sorted(want, key=lambda r: (repr(r[:5]), r[5]))):
        assert g[:5] == w[:5], (key(g), key(w))
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=4e-4 * g[2])


def some(n, seed, pool=40):
    r = random.Random(seed)
    return [(i, r.choice([" ", "\n", "\t\x0b"]).join(r.choice(["The", "the", "É", "é", "a b", f"w{r.randrange(pool)}"]) for _ in range(r.choice([0, 1, 2, 3, 30])))) for i in range(n)]


def test_scores_against_counters(spark):
    docs = some(150, 1) + [(300, None), (301, ""), (302, " \n"), (303, "only here"), (None, "the end"), (None, "the end"), (5, "w1 w2"), (5, "w1 w2")]
    same(run(spark, docs), docs)


@pytest.mark.parametrize("size", [8, 40])
def test_small_chunks_many_shards_and_hot_words(spark, size):
    """With tiny chunks "the" and the pair "the the" occur more often than a chunk has tokens and are dealt to all shards."""
    docs = some(60, 2) + [(100 + i, "the " * 20 + f"w{i}") for i in range(20)] + [(900 + i, f"the the w{i} x{i}") for i in range(30)]
    same(run(spark, docs, chunk=size), docs)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = some(20, 3)
    got = run(spark, docs, learn=F.lit(False))
    assert {(r[1], r[3], r[4], r[5], r[6]) for r in got} == {(False, 0, 0, 0.0, 0.0)}
    assert run(spark, docs, learn=F.lit(None).cast("boolean")) == got
    assert run(spark, []) == []


def test_long_text_and_partitioning(spark):
    docs = some(40, 4) + [(700, "the w1 w2 " * 100_000)]
    a, b = run(spark, docs, 1), run(spark, docs, 7)
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert np.allclose([r[6] for r in a], [r[6] for r in b])
    same(a, docs)


def test_model_file_is_mapped(spark, tmp_path):
    docs = some(50, 5)
    run(spark, docs, learn=F.lit(True), model=f"file://{tmp_path}/model")
    rows = spark.read.parquet(f"file://{tmp_path}/model").collect()
    (tmp_path / "trie").write_bytes(rows[0]["trie"])
    trie = Trie.map(tmp_path / "trie")
    seqs = [[1, 2, *words(t), 0] for _, t in docs]
    assert trie.pairs.n == len({p for s in seqs for p in zip(s, s[1:])})
    assert trie.triples.n == len({p for s in seqs for p in zip(s, s[1:], s[2:])})


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 1), (5, 3), (1000, 10**9), (1000, 50), (20000, 10**13)])
def test_elias_fano(n, most):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, most, n))
    seq = EliasFano(EliasFano.pack(v))
    assert (seq.get(np.arange(n)) == v).all()
    q = np.concatenate([v, r.integers(0, 2 * most + 5, 500)])
    place = np.searchsorted(v, q)
    there = place < n
    there[there] = v[place[there]] == q[there]
    assert (seq.find(q) == np.where(there, place, -1)).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    r = np.random.default_rng(1)
    runs = np.unique(r.integers(1, 30, (3000, 3)), axis=0)
    pair, of, n = np.unique(runs[:, 0] << 32 | runs[:, 1], return_inverse=True, return_counts=True)
    u, v = pair >> 32, pair & 0xFFFFFFFF
    trie = Trie(Trie.build(u, v, np.full(len(u), 0.5), np.ones(len(u)), n, runs[:, 2], np.linspace(0, 1, len(runs))))
    node = trie.pair(runs[:, 0], runs[:, 1])
    assert (node == of).all()
    assert (trie.triple(node, runs[:, 2]) == np.arange(len(runs))).all()
    assert np.allclose(shares(trie.triple_share[: len(runs)]), np.linspace(0, 1, len(runs)), rtol=3e-4)
    x = r.integers(0, 40, (5000, 3))
    has = {tuple(a) for a in runs.tolist()}
    assert ((trie.triple(trie.pair(x[:, 0], x[:, 1]), x[:, 2]) >= 0) == [tuple(a) in has for a in x.tolist()]).all()


def test_held_out_texts_score_higher_than_by_single_words(spark):
    """Neighbours matter: in a text of fixed phrases the next word is told by the ones before."""
    r = random.Random(7)
    phrases = [" ".join(f"p{i}w{j}" for j in range(6)) for i in range(30)]
    docs = [(i, " ".join(r.choices(phrases, k=8))) for i in range(80)]
    got = [x for x in run(spark, docs) if not x[1]]
    assert got and all(x[6] > x[5] for x in got)


def test_packing():
    for a in (np.empty(0, np.int64), np.array([-1, 0, 1 << 62]), np.arange(1000)):
        assert (unpack(pack(a)) == a).all()
    assert (np.abs(shares(quantise(np.array([0.0, 1e-9, 0.3, 1.0]))) / np.array([1, 1e-9, 0.3, 1.0]) - [0, 1, 1, 1]) < 1e-3).all()


def test_runs_of_a_chunk_take_bounded_memory():
    rng = np.random.default_rng(1)
    size = 200_000
    number, tokens, texts = np.arange(FIRST, FIRST + 30_000), rng.integers(0, 30_000, size), np.full(size // 100, 100 * 2 + 1)
    tracemalloc.start()
    win = Windows(number, tokens, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert win.count.sum() == size + len(texts)  # each place but a text's last two starts a run of known words
    assert peak < 95 * size
