"""Near-duplicates of embeddings by a robust-pruned flat graph (operator 3).

Distinct vectors are dealt to overlapping cluster shards, each to its two nearest clusters. In
every shard each vector gets edges to near ones, pruned so that an edge is dropped when a kept
neighbour is nearer to its end. The adjacency lists of a vector's shards are united. For the
search each vector goes to the shards of its nearest clusters, walks greedily from the shard's
medoid along the graph and then expands through everything within a widened range. What it finds
is verified by the cosine in double precision. An audit compares sampled vectors, and copies of them
turned a little more than half way to the threshold's angle, with brute force. The copies, which
always have a link, are searched like any vector and are in no result. Beam and routing widen until
the recall is met; only where all clusters are not enough are the vectors of each cell compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import components, forget, settle, spanning_labels


@dataclass(frozen=True)
class Config:
    """``sample`` vectors at most fit the clusters, of which there are ``max_clusters`` at most; all vectors are indexed."""

    threshold: float = 0.95
    shard: int = 1500
    max_clusters: int = 4096
    sample: int = 20_000
    block: int = 2048
    degree: int = 24
    keep: int = 8
    alpha: float = 1.2
    beam: int = 24
    slack: float = 0.1
    probes: int = 3
    audit: int = 128
    recall: float = 0.95


def _units(v: pa.Array) -> np.ndarray:
    x = np.array(v.flatten(), np.float64).reshape(len(v), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_clusters(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centres of unit vectors by spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def turned(x: np.ndarray, threshold: float, seed: int = 2) -> np.ndarray:
    """Unit vectors ``x``, each turned in a random direction by 0.1 to 0.9 of the threshold's angle."""
    rng = np.random.default_rng(seed)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(r, axis=1, keepdims=True)
    r = np.where(size > 1e-9, r / np.maximum(size, 1e-9), 0.0)  # one component leaves no direction
    angle = rng.uniform(0.1, 0.9, (len(x), 1)) * np.arccos(threshold)
    return np.cos(angle) * x + np.sin(angle) * r


def build_graph(x: np.ndarray, config: Config) -> np.ndarray:
    """Adjacency (n x degree, padded by -1) of the unit vectors of a shard, robustly pruned."""
    n, m = len(x), min(len(x) - 1, 2 * config.degree)
    out = np.full((n, config.degree), -1, np.int32)
    for i in range(0, n, 512) if m > 0 else ():
        rows = np.arange(i, min(n, i + 512))
        sim = x[rows] @ x.T
        sim[rows - i, rows] = -2
        near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        own = 1 - np.take_along_axis(sim, near, 1)
        alive = np.ones(near.shape, bool)
        for j in range(m):  # the j-th nearest, if still there, occludes what is much nearer to it
            between = 1 - np.einsum("rd,rmd->rm", x[near[:, j]], x[near])
            drop = alive[:, j, None] & (config.alpha * between < own)
            drop[:, : max(j + 1, config.keep)] = False
            alive &= ~drop
        rank = np.where(alive, np.cumsum(alive, 1) - 1, config.degree)
        r, c = np.nonzero(rank < config.degree)
        out[rows[r], rank[r, c]] = near[r, c]
    return out


def range_search(q: np.ndarray, x: np.ndarray, adj: np.ndarray, start: int, config: Config) -> np.ndarray:
    """Bool (queries x vectors): what a greedy walk from ``start`` and its range expansion find at the threshold."""
    n, wide, found_at = len(x), config.threshold - config.slack, config.threshold
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    out = np.zeros((len(q), n), bool)
    for lo in range(0, len(q), 256):
        qs, q64 = q32[lo : lo + 256], q[lo : lo + 256]
        m = len(qs)
        seen, near = np.zeros((m, n), bool), np.zeros((m, n), bool)
        ids = np.full((m, config.beam), -1, np.int64)
        sims, done = np.full((m, config.beam), -9, np.float32), np.ones((m, config.beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0], seen[:, start] = start, qs @ x32[start], False, True
        near[:, start] = sims[:, 0] >= wide
        while True:
            score = np.where(done, np.float32(-9), sims)
            at = score.argmax(1)
            live = np.flatnonzero(score[np.arange(m), at] > -9)
            if not len(live):
                break
            done[live, at[live]] = True
            nb = adj[ids[live, at[live]]]
            new = (nb >= 0) & ~seen[live[:, None], nb]
            s = np.where(new, np.einsum("ad,ard->ar", qs[live], x32[nb]), np.float32(-9))
            r, c = np.nonzero(new)
            seen[live[r], nb[r, c]] = True
            near[live[r], nb[r, c]] = s[r, c] >= wide
            all_ids, all_sims, all_done = np.hstack([ids[live], nb]), np.hstack([sims[live], s]), np.hstack([done[live], ~new])
            top = np.argpartition(-all_sims, config.beam - 1, axis=1)[:, : config.beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
        # everything within the widened range passes the search on to its neighbours
        r, c = np.nonzero(near)
        while len(r):
            later_r, later_c = [], []
            for i in range(0, len(r), 20_000):
                nb = adj[c[i : i + 20_000]]
                rr = np.repeat(r[i : i + 20_000], nb.shape[1])
                flat = nb.ravel()
                ok = flat >= 0
                ok[ok] = ~seen[rr[ok], flat[ok]]
                pair = np.unique(rr[ok] * n + flat[ok])
                rr, flat = pair // n, pair % n
                seen[rr, flat] = True
                close = np.einsum("pd,pd->p", qs[rr], x32[flat]) >= wide
                near[rr[close], flat[close]] = True
                later_r.append(rr[close])
                later_c.append(flat[close])
            r, c = np.concatenate(later_r), np.concatenate(later_c)
        r, c = np.nonzero(near)
        for i in range(0, len(r), 50_000):
            a, b = r[i : i + 50_000], c[i : i + 50_000]
            out[lo + a, b] = np.einsum("pd,pd->p", q64[a], x[b]) >= found_at
    return out


_CELL = "cluster long, block long, chunk long, role long, nid long, n long, v array<double>"


def _route(centres: np.ndarray, blocks: np.ndarray, chunks: np.ndarray, probes: int, build: bool):
    """Rows of cells. Roles: 0 a shard's own vector, 1 one of an overlapping shard, 2 a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nid, x = b.column(0).to_numpy(), _units(b.column(2))
            order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, : max(2, probes)]
            mix = (nid.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            rows = []
            for role in (0, 1) if build else (0, 1, 2):
                asked = np.flatnonzero(nid < 0) if role < 2 else np.empty(0, np.int64)  # audit queries are no nodes
                for j in (role,) if role < 2 else range(probes):
                    if j >= order.shape[1]:
                        continue
                    c = order[:, j]
                    # nodes stay in one block and meet all chunks of queries; queries the other way round
                    times = (np.ones(len(c), np.int64) if build else chunks[c]).copy() if role < 2 else blocks[c].copy()
                    times[asked] = 0
                    i = np.repeat(np.arange(len(c)), times)
                    k = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    own = mix[i] % (blocks if role < 2 else chunks)[c[i]].astype(np.uint64)
                    rows.append((c[i], own if role < 2 else k, k if role < 2 else own, np.full(len(i), role), i))
            c, blk, chunk, role, i = (np.concatenate(a) for a in zip(*rows, strict=True))
            for s in range(0, len(i), 10_000):
                p = slice(s, s + 10_000)
                take = pa.array(i[p])
                yield pa.RecordBatch.from_arrays([*(pa.array(a[p].astype(np.int64)) for a in (c, blk, chunk, role)), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)], ["cluster", "block", "chunk", "role", "nid", "n", "v"])

    return run


def _column(t: pa.Table, name: str) -> pa.Array:
    return t.column(name).combine_chunks()


def _build(config: Config):
    def run(t: pa.Table) -> pa.Table:
        nid = t.column("nid").to_numpy()
        adj = build_graph(_units(_column(t, "v")), config)
        return pa.table({"nid": pa.array(nid), "adj": pa.array([nid[a[a >= 0]].tolist() for a in adj], pa.list_(pa.int64()))})

    return run


def reachable(owner: np.ndarray, to: np.ndarray, n: int, start: int) -> np.ndarray:
    """Adjacency (n x widest, padded by -1) of the edges in both directions, with links from ``start`` to each part apart."""
    label, u, v = np.arange(n), np.r_[owner, to], np.r_[to, owner]
    while True:  # the least label travels along edges until it stays
        new = label.copy()
        np.minimum.at(new, u, label[v])
        if (new == label).all():
            break
        label = new
    apart = np.setdiff1d(np.unique(label), label[start])  # a part's label is one of its nodes
    pair = np.unique(np.r_[u * n + v, start * n + apart, apart * n + start])
    u, v = pair // n, pair % n
    count = np.bincount(u, minlength=n)
    adj = np.full((n, max(1, int(count.max(initial=0)))), -1, np.int64)
    adj[u, np.arange(len(u)) - np.repeat(np.cumsum(count) - count, count)] = v
    return adj


def _search(config: Config, exact: bool = False):
    def run(t: pa.Table) -> pa.Table:
        """(nid, links, root): the number of rows that each query links with among the shard's own vectors, and edges (nid, root)."""
        role, nid, n = (t.column(c).to_numpy() for c in ("role", "nid", "n"))
        x = _units(_column(t, "v"))
        node, ask = np.flatnonzero(role < 2), np.flatnonzero(role == 2)
        none = pa.table({"nid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(node) or not len(ask):
            return none
        ids = nid[node]
        by_id = np.argsort(ids)
        lists = t.column("adj").to_pylist()
        flat = np.array([a for i in node for a in lists[i] or ()], np.int64)
        owner = np.repeat(np.arange(len(node)), [len(lists[i] or ()) for i in node])
        at = np.minimum(np.searchsorted(ids[by_id], flat), len(ids) - 1)
        here = ids[by_id][at] == flat  # what lies in other shards is not reachable here
        points = x[node]
        if exact:
            found = np.zeros((len(ask), len(node)), bool)
            for i in range(0, len(ask), 512):
                found[i : i + 512] = x[ask[i : i + 512]] @ points.T >= config.threshold
        else:
            medoid = int((points @ points.mean(0)).argmax())
            adj = reachable(owner[here], by_id[at[here]], len(node), medoid)
            found = range_search(x[ask], points, adj, medoid, config)
        found &= (nid[ask][:, None] != ids[None, :]) & (role[node] == 0)[None, :]
        audit = nid[ask] < 0
        q, links = found.any(1), found @ n[node]
        if not q.any():
            return none
        own, checked = q & ~audit, nid[ask][q & audit]
        label_q, label_n = spanning_labels(found[own])
        has = found[own].any(0)
        u, root = np.r_[nid[ask][own], ids[has], checked], np.r_[ids[np.r_[label_q, label_n[has]]], checked]
        more = np.r_[links[own], np.zeros(int(has.sum()), np.int64), links[q & audit]]
        return pa.table({"nid": pa.array(u), "links": pa.array(more), "root": pa.array(root)})

    return run


def _brute(queries: np.ndarray, ids: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            x = _units(b.column(2)).T
            for i in range(0, len(ids), 256):
                found = queries[i : i + 256] @ x >= threshold
                found &= ids[i : i + 256, None] != b.column(0).to_numpy()[None, :]
                total[i : i + 256] += found @ b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["nid", "links"])

    return run


def near_vectors(vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) of every row of ``vectors(vec_id, embedding)``.

    n_links counts the other rows with a cosine of the threshold or more, component_id is the
    smallest vec_id that links reach, kept tells whether it is the row's own. Vectors that are
    null, empty, zero or hold nulls or non-finite numbers link with nothing; vectors of different
    lengths don't link. Equal vectors are one node of the graph and count with their number. A
    null vec_id takes the component of its links and is not kept. An empty table gives no rows.
    audit_recall is the mean share of the links that the search found, over ``config.audit`` sampled
    vectors that have any and as many turned copies of them.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", v.alias("v")).withColumn("fine", fine)
    big = F.array_max(F.transform("v", F.abs))  # scaled so that no square leaves the range of doubles
    rows = rows.withColumn("v", F.when(F.col("fine"), F.transform("v", lambda x: x / big + F.lit(0.0))))
    key = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.reverse("v"))})
    good = key.filter("fine")
    distinct = settle(good.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v")).withColumn("nid", F.monotonically_increasing_id()), "vectors")
    links, edges, recall = None, None, []
    for (dim,) in distinct.select(F.size("v")).distinct().collect():
        found, e, r = _links(distinct.filter(F.size("v") == dim).select("nid", "n", "v"), config)
        links, edges = (found, e) if links is None else (links.unionByName(found), edges.unionByName(e))
        recall.append(r)
    out = key.select("vec_id", "fine", "k1", "k2")
    if links is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), F.lit(1.0).alias("audit_recall"))
    nodes = settle(components(edges).toDF("nid", "root"), "roots")
    named = distinct.join(nodes, "nid", "left").join(links, "nid", "left").select("k1", "k2", "n", "least", F.coalesce("root", "nid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = settle(named, "named")
    least = settle(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    per = settle(named.join(least, "root").select("k1", "k2", F.lit(True).alias("known"), (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"), "per-vector")
    done = out.join(per, ["k1", "k2"], "left")
    own = F.col("fine") & F.col("known")
    done = done.select("vec_id", F.when(own, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(own, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return done.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(float(min(recall))).alias("audit_recall"))


def _links(d: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, float]:
    """((nid, links), edges(u, v), recall) of distinct vectors d(nid, n, v) of one length."""
    spark, total = d.sparkSession, d.count()
    some = d.orderBy(F.xxhash64("nid")).limit(config.sample).toArrow()
    x, ids = _units(_column(some, "v")), some.column("nid").to_numpy()
    k = int(min(len(x), config.max_clusters, max(1, -(-total // config.shard))))
    centres = fit_clusters(x, k)
    audit = min(len(x), config.audit)
    copies = turned(x[:audit], config.threshold)
    queries, names = np.concatenate([x[:audit], copies]), np.concatenate([ids[:audit], -1 - np.arange(audit)])
    asked = spark.createDataFrame([(int(i), 0, v) for i, v in zip(names[audit:], copies.tolist(), strict=True)], "nid long, n long, v array<double>")
    truth = settle(d.mapInArrow(_brute(queries, names, config.threshold), "nid long, links long").groupBy("nid").agg(F.sum("links").alias("t")).filter("t > 0"), "audit")
    ones = np.ones(k, np.int64)
    size = np.zeros(k, np.int64)
    own = d.mapInArrow(_route(centres, ones, ones, 0, True), _CELL).filter("role = 0").groupBy("cluster").count()
    for r in own.collect():  # a row for each cluster
        size[r["cluster"]] = r["count"]
    blocks = np.maximum(1, -(-size // config.block))
    graph = d.mapInArrow(_route(centres, blocks, ones, 0, True), _CELL).groupBy("cluster", "block").applyInArrow(_build(config), "nid long, adj array<long>")
    graph = settle(graph.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj")), "graph")
    probes, exact = min(k, config.probes), False
    while True:
        chunks = np.maximum(1, -(-size * probes // (2 * config.block)))
        cells = d.unionByName(asked).mapInArrow(_route(centres, blocks, chunks, probes, False), _CELL)
        cells = cells.join(graph, "nid", "left").withColumn("adj", F.when(F.col("role") < 2, F.col("adj")))
        hits = settle(cells.groupBy("cluster", "block", "chunk").applyInArrow(_search(config, exact), "nid long, links long, root long"), "hits")
        links = settle(hits.groupBy("nid").agg(F.sum("links").alias("links")), "links")
        recall = truth.join(links, "nid", "left").agg(F.avg(F.least("t", F.coalesce("links", F.lit(0))) / F.col("t"))).first()[0]
        if recall >= config.recall or exact:
            forget(truth)
            forget(graph)
            return links, hits.filter("nid <> root").select(F.col("nid").alias("u"), F.col("root").alias("v")), recall
        forget(hits)
        forget(links)
        exact = probes == k  # with all clusters asked the graph is not enough
        probes = min(k, 2 * probes)
        config = replace(config, beam=2 * config.beam)
