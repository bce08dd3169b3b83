"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from siltstone.llm import neighbours

VEC = "vec_id long, embedding array<double>, a int, v string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 1) for r in rows], VEC)


def brute(rows, queries, k):
    """Rows by number; a query's own row is that number."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in queries:
        if q not in ok:
            continue
        scaled = lambda v: np.array(v) / max(map(abs, v))
        a = scaled(rows[q][1])
        near = [(round(-float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b))), 12), rows[i][0] is None, rows[i][0] or 0) for i in ok if i != q and len(rows[i][1]) == len(a) for b in [scaled(rows[i][1])]]
        out += [(rows[q][0], r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect()), key=str)


def test_hash_functions():
    rng = np.random.default_rng(1)
    x = neighbours.unit(rng.normal(size=(200, 24)))
    for y in neighbours.axes(x, 3, 2):
        assert y.shape == (200, 64) and np.allclose((y[:, :32] ** 2).sum(1), 1) and np.allclose(y[:, :32], -y[:, 32:])
    near = neighbours.unit(x + 0.02 * rng.normal(size=x.shape))
    assert (neighbours.buckets(x, 0, 1) == neighbours.buckets(near, 0, 1)).mean() > 0.8
    for depth, n in ((1, 64), (2, 64**2), (3, 500)):
        probed = neighbours.probes(x[:20], 1, depth, n)
        assert (probed[:, 0] == neighbours.buckets(x[:20], 1, depth)).all() and all(len(set(p)) == n for p in probed.tolist())
        at, home = neighbours.places(x[:20], near[20:40], 1, depth), neighbours.buckets(near[20:40], 1, depth)
        for p, place, bucket in zip(probed.tolist(), at.tolist(), home.tolist()):
            assert p.index(bucket) == place if bucket in p else place >= n


@pytest.mark.parametrize("target,block", [(4096, 4096), (20, 50)])
def test_recall(spark, target, block):
    """Clustered and isotropic vectors, one and two functions a table, with blocks: recall by brute force over all queries."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[1000:2500] = x[np.arange(1500) % 100] + 0.4 * rng.normal(size=(1500, 16))
    x[2500:] = x[0] + 0.01 * rng.normal(size=(500, 16))
    rows = list(enumerate(x.tolist()))
    got = result(neighbours.nearest(frame(spark, rows[::20]), frame(spark, rows), target=target, block=block, sample=60))
    want = brute(rows, range(0, 3000, 20), 5)
    assert len(got) == len(want) and len(set(got) & set(want)) / len(want) > 0.95


def test_hostile_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6)).round(2).tolist()
    rows = list(enumerate(base)) + [(40 + i, base[0]) for i in range(60)]  # a vector that over half of the rows have
    rows += [(0, base[0]), (0, base[0]), (3, base[9]), (None, base[4]), (None, base[4]), (200, [5 * c for c in base[7]]), (201, None), (202, []), (203, [0.0] * 6), (204, [1.0, math.nan] * 3), (205, [1.0, None] * 3), (206, [math.inf] * 6), (207, [1.0, 2.0]), (208, [2.0, 1.0]), (209, [1e200] * 6), (210, [1e-200] * 6)]
    queries = [i for i, r in enumerate(rows) if r[0] is not None and r[0] % 3 == 0]
    df = frame(spark, rows)
    got = result(neighbours.nearest(df.where("vec_id % 3 = 0"), df.repartition(6), block=7))
    want = brute(rows, queries, 5)
    assert [(q, r, round(s, 9)) for q, r, _, s in got] == [(q, r, round(s, 9)) for q, r, _, s in want]
    copies = lambda a: {x for x in a if x[0] % 20 == 0 or 40 <= x[0] < 100}
    assert copies(got) == copies(want) and len(copies(want)) > 100  # ids, too, where all ties are of one vector


def test_few_and_none(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 1.0])])
    assert len(result(neighbours.nearest(df.where("vec_id % 50 = 0"), df))) == 4
    assert neighbours.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert neighbours.nearest(df.where("false"), df).count() == 0
    assert neighbours.nearest(df, df.where("false")).count() == 0


def test_probes_grow_until_the_check_holds(spark):
    """A fit on easy queries only is widened by the queries that check it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    rows = list(enumerate(x.tolist()))
    nodes = neighbours._sound(frame(spark, rows), "vec_id", "id")
    low, _ = neighbours.fitted_probes(nodes.limit(40), nodes, 5, 1, sample=20, goal=0.1, least=0.0)
    high, share = neighbours.fitted_probes(nodes.limit(40), nodes, 5, 1, sample=20, goal=0.1, least=0.95)
    assert low < high <= 32 and share >= 0.95
