"""Centroid clustering by plain Lloyd rounds over integer vectors (operator 13).

Vectors become integers once, so that sums, distances and ties are exact whatever the partitioning.
Each round broadcasts the centroids (k rows of fixed width), finds for every vector the nearest one
in NumPy, and merges integer sums of partitions through a groupBy of k keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, settle

#: Scaled components stay below this size, so that a squared distance over 64 of them fits a long.
WIDEST = 1 << 27
#: Vectors that are compared at a time.
_BLOCK = 4096


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(``scale`` * component), in doubles, of each vector with exactly ``dims`` components.

    Vectors that are null, of another length, or hold a null, a NaN, an infinity or a component
    whose scaled size reaches 2^27 are left out.
    """
    v = F.col(vector_col)
    x = F.transform(v, lambda a: F.floor(a.cast("double") * scale))
    fits = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double") * scale) < WIDEST))
    return vectors.filter((F.size(v) == dims) & F.coalesce(fits, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda a: a.cast("int")).alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors (or all) with the smallest sha256 of ``seed:vec_id``, in that order; ties by components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row, ties to the smaller number."""
    d = np.empty((len(x), len(centroids)), np.int64)
    for at in range(0, len(x), _BLOCK):
        part = x[at : at + _BLOCK]
        for c, centroid in enumerate(centroids):
            diff = part - centroid
            d[at : at + _BLOCK, c] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def _matrix(x: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate(x.to_list()).astype(np.int64).reshape(-1, dims) if len(x) else np.empty((0, dims), np.int64)


def _sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, sums of their components), k rows at most."""
    k, dims = centroids.shape
    sent = kept.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{i}" for i in range(dims)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = _matrix(b["x"], dims)
            best, _ = nearest(x, sent.value)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best):
                s[c] += x[best == c].sum(0)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some, "n": n[some]} | {a: s[some, i] for i, a in enumerate(names)})

    parts = kept.select("x").mapInPandas(run, "cluster long, n long, " + ", ".join(f"{a} long" for a in names))
    rows = parts.groupBy("cluster").agg(*(F.sum(F.col(a).cast("decimal(38,0)")).alias(a) for a in ("n", *names))).collect()
    sent.destroy()
    return {r["cluster"]: (int(r["n"]), [int(r[a]) for a in names]) for r in rows}


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Centroids start as :func:`first_centroids`; each of ``rounds`` rounds assigns all vectors and
    replaces every non-empty centroid by the componentwise floor of its vectors' mean, then all are
    assigned once more. Kept are the vectors of :func:`integer_vectors`, the others give no row;
    repeated rows and repeated ids count as often as they stand there, a null id is a value of its
    own that starts no cluster while others are left. Fewer than ``k`` vectors start as many
    clusters; an empty table gives no rows. Other columns, whatever their names, are not read.
    The driver holds k centroids and k rows of sums, nothing that grows with the vectors.
    """
    kept = settle(integer_vectors(vectors, dims, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(kept, k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        new = centroids.copy()
        for c, (n, s) in _sums(kept, centroids).items():
            new[c] = [a // n for a in s]
        if (new == centroids).all():
            break  # assignments can't change any more
        centroids = new
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best, d = nearest(_matrix(b["x"], dims), centroids)
                yield pd.DataFrame({"row": b["row"], "cluster": best.astype(np.int32), "distance": d, "centroid_sha256": [digest[c] for c in best]})

    kind = kept.schema["vec_id"].dataType.simpleString()
    # ids stay in a struct, as pandas would turn longs with a null among them into doubles
    rows = kept.select(F.struct("vec_id").alias("row"), "x")
    assigned = settle(rows.mapInPandas(assign, f"row struct<vec_id:{kind}>, cluster int, distance long, centroid_sha256 string"), "assigned")
    forget(kept)
    of_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    totals = {r["cluster"]: int(r["s"]) for r in of_cluster}  # k rows
    of = F.element_at(F.array(*(F.lit(totals.get(c, 0)).cast("long") for c in range(max(len(centroids), 1)))), F.col("cluster") + 1)
    return assigned.select(F.col("row.vec_id").alias(id_col), "cluster", "distance", of.alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"), "centroid_sha256")
