"""The quantised multi-vector index against the exact similarity join."""

import numpy as np
import pytest

from siltstone.operators import index, topk


def tables(spark, n, m, width=8, tokens=4, splits=("a",), seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, tokens * width))
    rows = lambda count, name: spark.createDataFrame([(splits[i % len(splits)], i, (centre[i % 40] + 0.7 * rng.normal(size=tokens * width)).tolist()) for i in range(count)], f"split string, {name} bigint, v array<double>")
    return rows(n, "query_id"), rows(m, "document_id")


def found(df):
    return sorted((r.split or "", r.query_id, r["rank"], r.document_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_codes(bits):
    rng = np.random.default_rng(bits)
    codec = index.Codec(rng.normal(size=(9, 6)), 2.5, bits)
    x = codec.centroids[rng.integers(0, 9, 50)] + rng.uniform(-1, 1, (50, 6))
    of = codec.assigned(x)
    assert (of == ((x[:, None] - codec.centroids) ** 2).sum(2).argmin(1)).all()
    levels = codec.levels(x, of)
    assert levels.max() < 1 << bits and (codec.unpack(codec.pack(levels), levels.size).reshape(levels.shape) == levels).all()
    assert len(codec.pack(levels)) == -(-levels.size * bits // 8) and (np.abs(codec.decoded(levels, of) - x) <= codec.step / 2 + 1e-12).all()


@pytest.mark.parametrize("most", [10**8, 20_000])
def test_nothing_is_lost_with_all_lists_and_the_whole_bound(spark, most):
    q, d = tables(spark, 70, 600, splits=("a", "b"))
    codec = index.trained(d, 4, centroids=16)
    lists = index.staged(index.built(d, codec, 4, block=90), "lists")
    assert lists.count() == 8 and all(np.all(np.diff(r.centroid) >= 0) and len(r.ids) <= 90 for r in lists.collect())
    got = index.indexed_topk(q, d, lists, codec, 7, 4, 16, slack=1.0, most=most)
    assert found(got) == found(topk.similarity_topk(q, d, 7, 4))
    assert max(r.scored for r in got.collect()) < 300


def test_recall_at_100(spark):
    """Recall of 0.9 at least with a quarter of the documents scored at most, over one space of ids."""
    q, d = tables(spark, 40, 4000, splits=("a", "b", "c"))
    codec = index.trained(d, 4)
    assert len(codec.centroids) == 512
    lists = index.staged(index.built(d, codec, 4, block=500), "lists")
    got = index.staged(index.indexed_topk(q, d, lists, codec, 100, 4, 128, within_split=False), "found")
    exact = topk.similarity_topk(q, d, 100, 4, within_split=False)
    rows = index.recall(got, exact, d.selectExpr("explode(array('a', 'b', 'c')) as split", "document_id")).collect()
    assert sum(r.queries for r in rows) == 40 and all(r.recall >= 0.9 and r.scored_share < 0.25 for r in rows)


def test_files_and_edges(spark, tmp_path):
    q, d = tables(spark, 5, 60)
    missing = spark.createDataFrame([("a", 900, None), (None, 901, [0.5] * 32), ("z", 902, [0.0] * 32)], "split string, document_id bigint, v array<double>")
    d = d.union(missing)
    asked = q.union(spark.createDataFrame([("a", 77, None), (None, 78, [1.0] * 32), ("y", 79, [1.0] * 32)], "split string, query_id bigint, v array<double>"))
    codec = index.trained(d, 4, centroids=8, rounds=0)
    index.write_index(index.built(d, codec, 4), codec, str(tmp_path))
    lists, read = index.read_index(spark, str(tmp_path))
    assert np.array_equal(read.centroids, codec.centroids) and (read.reach, read.bits) == (codec.reach, codec.bits)
    got = index.indexed_topk(asked, d, lists, read, 100, 4, 3)
    assert {r.query_id for r in got.collect()} == {0, 1, 2, 3, 4} and got.count() == 300
    assert index.candidates(asked.where("split is null"), index.built(d, codec, 4), codec, 3, 4, 8).collect()[0].document_id == 901
    assert index.indexed_topk(asked.where("false"), d, lists, read, 3, 4, 3).count() == 0
    assert index.indexed_topk(asked, d, lists.where("false"), read, 3, 4, 3).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        index.trained(d.where("false"), 4)
