import numpy as np

from archgraph.llm import vector_dedup
from archgraph.llm.vector_dedup import Config, near_vectors


def _expected(ids, x, threshold):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    near = (x / norm) @ (x / norm).T >= threshold
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


def test_against_brute_force_with_copies_and_a_large_group(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(150, 16))
    x = [base, base[:40] + 0.05 * r.normal(size=(40, 16)), base[:20] * 3, base[7] + 0.03 * r.normal(size=(250, 16))]
    x = np.concatenate(x)
    ids = r.permutation(len(x)).tolist()
    rows = [(i, v.tolist(), 0, 9) for i, v in zip(ids, x, strict=True)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [float("inf")] * 16]
    rows += [(1000 + i, v, 0, 9) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = {g["vec_id"]: g for g in near_vectors(df, Config(shard=60, block=64, audit=30)).collect()}
    assert len(got) == len(rows)
    links, component = _expected(ids, x, 0.95)
    assert sum(min(got[i]["n_links"], n) for i, n in zip(ids, links, strict=True)) >= 0.97 * links.sum()
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, links, strict=True))
    assert np.mean([got[i]["component_id"] == c for i, c in zip(ids, component, strict=True)]) > 0.97
    for i in range(1000, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[ids[0]]["audit_recall"] >= 0.9


def test_equal_vectors_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [2.0, 0.0]), (3, [1.0, -0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(g["vec_id"]), g["n_links"], g["component_id"], g["kept"]) for g in near_vectors(df).collect())
    assert got == [("3", 3, 3, True), ("3", 3, 3, True), ("4", 3, 3, False), ("9", 0, 9, True), ("None", 3, 3, False)]
    assert near_vectors(df.limit(0)).count() == 0


def test_search_that_misses_falls_back_to_exact(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 8))
    x = np.concatenate([base, base + 0.02 * r.normal(size=(60, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_dedup, "_build", lambda config: lambda t: t.select(["nid"]).append_column("adj", [[[]] * len(t)]).cast(vector_dedup.pa.schema([("nid", vector_dedup.pa.int64()), ("adj", vector_dedup.pa.list_(vector_dedup.pa.int64()))])))
    monkeypatch.setattr(vector_dedup, "reachable", lambda owner, to, n, start: np.full((n, 1), -1))
    got = {g["vec_id"]: g for g in near_vectors(df, Config(shard=60)).collect()}
    links, component = _expected(list(range(120)), x, 0.95)
    assert [got[i]["n_links"] for i in range(120)] == links.tolist()
    assert [got[i]["component_id"] for i in range(120)] == component.tolist()


def test_rare_links_are_found_and_audited(spark):
    x = np.random.default_rng(4).normal(size=(700, 24))
    x[699] = x[698] * 1.01 + 0.001
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {g["vec_id"]: g for g in near_vectors(df, Config(audit=8, shard=100)).collect()}
    assert (got[699]["n_links"], got[699]["component_id"]) == (1, 698)
    assert got[0]["audit_recall"] >= 0.95  # a number, though no sampled vector has a link


def test_every_part_is_reachable_from_the_start():
    adj = vector_dedup.reachable(np.array([0, 1, 4]), np.array([1, 2, 3]), 6, 2)
    seen, todo = {2}, [2]
    while todo:
        for b in adj[todo.pop()].tolist():
            if b >= 0 and b not in seen:
                seen.add(b)
                todo.append(b)
    assert seen == set(range(6))


def test_planted_links_come_through_the_graph(spark, monkeypatch):
    """30,000 vectors in 75 clusters with 1,500 planted copies at cosines above 0.95: no cell is compared one by one."""
    r = np.random.default_rng(6)
    base = r.normal(size=(28_500, 32)) + 2 * r.normal(size=(60, 32))[r.integers(0, 60, 28_500)]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pick = r.choice(len(base), 1500, replace=False)
    x = np.concatenate([base, vector_dedup.turned(base[pick], 0.955)])
    search = vector_dedup._search

    def by_graph(config, exact=False):
        assert not exact
        return search(config, exact)

    monkeypatch.setattr(vector_dedup, "_search", by_graph)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = near_vectors(df, Config(shard=400)).toPandas().set_index("vec_id")
    links = np.concatenate([((x[i : i + 2000] @ x.T) >= 0.95).sum(1) - 1 for i in range(0, len(x), 2000)])
    has = np.flatnonzero(links)
    assert len(has) >= 3000
    found = np.minimum(got["n_links"].to_numpy()[has], links[has]) / links[has]
    assert found.mean() >= 0.9 and got["audit_recall"].min() >= 0.9
    assert (got["n_links"].sort_index().to_numpy() <= links).all()


def test_turned_copies_stay_within_the_threshold():
    x = np.random.default_rng(8).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = (x * vector_dedup.turned(x, 0.95)).sum(1)
    assert cosine.min() > 0.95 and cosine.max() < 1
    assert np.isfinite(vector_dedup.turned(np.array([[1.0]]), 0.95)).all()
