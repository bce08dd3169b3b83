"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from siltstone.llm import embeddings

VEC = "vec_id long, embedding array<float>, node long, v int, shard string"


def brute(x, least=0.9):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a = u @ u.T >= least
    np.fill_diagonal(a, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(a, label[None, :], len(x)).min(1, initial=len(x)))
        if (new == label).all():
            return a.sum(1), label
        label = new


def clustered(n, dim, seed):
    """Random vectors, groups at all cosines about the threshold, one large group, exact copies and scaled ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 3, 6):
        noise = rng.uniform(0.05, 0.9)
        x[i + 1 : i + 6] = x[i] + noise * rng.normal(size=(5, dim)) * np.linalg.norm(x[i]) / dim**0.5
    big = n // 2
    x[big : big + n // 8] = x[big] + 0.1 * rng.normal(size=(n // 8, dim))
    x[-20:-10] = x[-20]
    x[-10:] = x[5] * np.linspace(1, 9, 10)[:, None]
    return x.astype(np.float32)


@pytest.mark.parametrize("n,block,target", [(1500, 1024, 200), (900, 100, 300)])
def test_recall_and_precision(spark, n, block, target):
    x = clustered(n, 24, 3)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, "s") for i, v in enumerate(x)], VEC)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block, target=target).collect()}
    links, label = brute(x)
    mine = np.array([got[i].n_links for i in range(n)])
    assert (mine <= links).all() and mine.sum() >= 0.97 * links.sum()
    comp = np.array([got[i].component_id for i in range(n)])
    assert (comp == label).mean() > 0.97 and (comp >= label).all()
    assert all(got[i].kept == (comp[i] == i) for i in range(n))


def test_audit(spark, monkeypatch):
    """A graph that loses links is built again with more overlap; where that never helps, there is an error and no result."""
    x = clustered(600, 16, 5)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, "s") for i, v in enumerate(x)], VEC)
    whole, tried = embeddings.links, []

    def lossy(nodes, *, overlap, **how):
        tried.append(overlap)
        found = whole(nodes, overlap=overlap, **how)
        return found if overlap >= 12 else found.withColumn("links", embeddings.F.col("links") * 0)

    monkeypatch.setattr(embeddings, "links", lossy)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, target=100).collect()}
    links, _ = brute(x)
    assert tried == [3, 6, 12] and sum(got.values()) >= 0.97 * links.sum()
    monkeypatch.setattr(embeddings, "CENTROIDS", 6)
    with pytest.raises(RuntimeError, match="recall"):
        embeddings.near_duplicates(df, target=100)


def test_links_in_every_band(spark):
    """10**4 vectors, pairs at cosines from 0.86 to 0.99 by design: none missed in any band, none under 0.9 linked."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bands = [0.86, 0.89, 0.899, 0.901, 0.91, 0.93, 0.96, 0.99]
    for i in range(3000):
        side = x[2 * i + 1] - (x[2 * i + 1] @ x[2 * i]) * x[2 * i]
        side /= np.linalg.norm(side)
        c = bands[i % 8]
        x[2 * i + 1] = c * x[2 * i] + (1 - c * c) ** 0.5 * side
    df = spark.createDataFrame([(i, v.tolist(), 0, 0, "s") for i, v in enumerate(x.astype(np.float32))], VEC)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    found = np.array([[got[2 * i].n_links == 1 and got[2 * i + 1].component_id == 2 * i for i in range(b, 3000, 8)] for b in range(8)])
    assert not found[:3].any() and sum(r.n_links for r in got.values()) == 2 * found.sum()
    assert (found[3:].mean(1) >= 0.97).all(), found.mean(1)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    vs = [None, [], [0.0, 0.0], [1.0, None], [inf, 1.0], [nan, 1.0], [1.0, 0.0], [2.0, 0.1], [1.0, 0.0, 0.0], [-1.0, 0.0]]
    rows = [(i, v, 0, 0, "s") for i, v in enumerate(vs)] + [(None, [1.0, 0.0], 0, 0, "s"), (7, [2.0, 0.1], 0, 0, "s"), (20, [1e-30, 0.0], 0, 0, "s")]
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, VEC)).collect())
    assert got == sorted([(-1, 4, 6, False), *[(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 8, 9)], (6, 4, 6, True), (7, 4, 6, False), (7, 4, 6, False), (20, 4, 6, False)])
    assert embeddings.near_duplicates(spark.createDataFrame([], VEC)).count() == 0
