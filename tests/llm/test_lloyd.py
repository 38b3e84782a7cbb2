"""Centroid clustering against exact integers of Python."""

import hashlib
import math

import numpy as np
import pytest

from archgraph.llm.lloyd import cluster_vectors, nearest

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string"


def brute(rows, k=8, rounds=10, seed=3, dims=64):
    kept = [(i, [math.floor(1024 * a) for a in v]) for i, v in rows if v is not None and len(v) == dims and all(a is not None and math.isfinite(a) for a in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        of = [find(v)[1] for _, v in kept]
        cs = [[sum(x) // len(x) for x in zip(*g)] if (g := [v for (_, v), n in zip(kept, of) if n == c]) else old for c, old in enumerate(cs)]
    got = [(i, *find(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, n, d in got if n == c) for c in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in got), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7, "y") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster_vectors(df, **options).collect()), key=repr)


def test_odd_vectors_repeats_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (5, rows[8][1]), (None, rows[9][1])] + [(100 + i, rows[0][1]) for i in range(30)]  # copies, ties at distance 0
    bad = [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.1] * 63), (205, [math.nan] + [0.1] * 63), (206, [math.inf] + [0.1] * 63)]
    assert run(spark, rows + bad) == brute(rows)


def test_fewer_vectors_than_centroids_and_empty_ones(spark):
    same = [(i, [0.25] * 64) for i in range(5)]
    assert run(spark, same) == brute(same)
    assert {r[1] for r in run(spark, same)} == {0}  # ties go to the smallest number, the other centroids stay empty
    assert run(spark, []) == []


def test_negative_means_are_floored(spark):
    rows = [(0, [-0.001, 0.0]), (1, [0.0, 0.0]), (2, [-0.002, -0.0005])]
    assert run(spark, rows, k=1, dims=2, rounds=2) == brute(rows, k=1, dims=2, rounds=2)


def test_components_too_wide_for_exact_longs_are_left_out(spark):
    rows = [(0, [1.0, 2.0]), (1, [131072.0, 0.0]), (2, [131071.0, -131071.0])]
    assert [r[0] for r in run(spark, rows, k=2, dims=2)] == [0, 2]


@pytest.mark.parametrize("n", [1, 5000])
def test_nearest_in_blocks(n):
    rng = np.random.default_rng(n)
    x, c = rng.integers(-50, 50, (n, 4)), rng.integers(-50, 50, (3, 4))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    best, at = nearest(x, c)
    assert (best == d.argmin(1)).all() and (at == d.min(1)).all()
