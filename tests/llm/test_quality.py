"""The conditional random field against enumeration, and held-out accuracy."""

from itertools import product

import time

import numpy as np
import pytest

from siltstone.llm import quality

DOCS = "doc_id long, text string, score string, id string, good int"


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    sizes, move = np.array([1, 4, 2, 5]), rng.normal(size=(2, 2))
    score = rng.normal(size=sizes.sum())
    logit, pairs, total = quality.marginals(score, move, sizes)
    at, want_total, want_pairs = 0, 0.0, np.zeros((2, 2))
    for n in sizes:
        paths = list(product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(score[at + i] * y for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        want_total += np.log(w.sum())
        p = w / w.sum()
        for i in range(n):
            good = sum(q for q, y in zip(p, paths) if y[i])
            assert logit[at + i] == pytest.approx(np.log(good / (1 - good)))
        for q, y in zip(p, paths):
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += q
        at += n
    assert total == pytest.approx(want_total) and pairs == pytest.approx(want_pairs)


def test_features_of_lines():
    x, length, sizes = quality.line_features([b"", b"Ab c.\n\nX!!", b"\n"])
    assert sizes.tolist() == [1, 3, 2] and length.tolist() == [1, 6, 1, 4, 1, 1]
    one = quality.line_features([b"Ab c.\n\nX!!"])[0]
    assert np.allclose(one, x[1:4])


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op4_quality(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for _, p, y in held]) > 0.93
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_scores_by_enumeration(spark, sf):
    """The query's scores from its model's weights, by all labelings of a document's lines."""
    rest = quality.F.crc32(quality.F.col("doc_id").cast("string")) % 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), usable=rest != 0)
    got, seen = {r.doc_id: r for r in quality.op4_quality(spark, sf).collect()}, 0
    for r in docs.collect():
        x, weight, sizes = quality.line_features([(r.text or "").encode()])
        if sizes[0] <= 8:
            logit, seen = ((x - model.mean) / model.scale) @ model.w, seen + 1
            paths = list(product((0, 1), repeat=int(sizes[0])))
            w = np.exp([sum(s * y for s, y in zip(logit, p)) + sum(model.move[a, b] for a, b in zip(p, p[1:])) for p in paths])
            good = w / w.sum() @ np.array(paths)
            q = np.clip((good * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
            assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-model.curve[0] * np.log(q / (1 - q)) - model.curve[1])), abs=1e-6)
            assert (got[r.doc_id].n_lines, got[r.doc_id].n_good) == (sizes[0], (good >= 0.5).sum())
    assert seen > 30


def test_lines_of_both_kinds():
    """Documents that hold lines of both kinds: the chain labels line by line, though only documents have labels."""
    rng = np.random.default_rng(2)
    good, bad = b"The quick brown fox went over to the old mill, and stayed there.", b"BUY $$$ NOW!!! buy *** more"
    kinds = [np.where(rng.random(8) < (0.1 if i % 2 else 0.7), 0, 1) for i in range(300)]
    kinds = [k for i, k in enumerate(kinds) if (k.mean() > 0.6) == bool(i % 2)]
    label = np.array([int(k.mean() > 0.6) for k in kinds])
    texts = [b"\n".join([bad * int(rng.integers(2, 4)), good][x] for x in k) for k in kinds]
    model = quality.Model(*quality.line_features(texts), label)
    same = [(model.lines(t) >= 0.5) == k for t, k in zip(texts, kinds)]
    by_document = np.mean(np.repeat(label, 8) == np.concatenate(kinds))
    assert np.mean(np.concatenate(same)) > by_document + 0.04 and np.mean(np.concatenate([s for s, y in zip(same, label) if not y])) > 0.75
    score, n, of = model.score(texts)
    assert (n == 8).all() and (of < 8).sum() > 50 and np.mean((score >= 0.5) == label) > 0.95


def test_relabelled_keeps_half():
    got = quality.relabelled(np.array([1, 0]), np.array([-3.0, -1.0, 2.0, 4.0, 3.0, -1.0]), np.array([2, 3, 5, 9, 1, 8]), np.array([3, 3]))
    assert got.tolist() == [0, 0, 1, 1, 0, 0]  # 2 + 3 of 10 turn, and 9 of 18, the surest; then the half is reached
    got = quality.relabelled(np.array([0]), np.array([4.0, 3.0, -1.0]), np.array([10, 1, 8]), np.array([3]))
    assert got.tolist() == [0, 0, 0]  # the surest would pass the half, and ends it


def by_loop(score, move, sizes):
    """Forward-backward of each chain, line by line."""
    logit, pairs, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in sizes:
        node = np.stack((np.zeros(n), score[at : at + n]), 1)
        f, b = [node[0]], [np.zeros(2)]
        for t in range(1, n):
            f.append(node[t] + [np.logaddexp(f[-1][0] + move[0, s], f[-1][1] + move[1, s]) for s in (0, 1)])
        for t in range(n - 2, -1, -1):
            y = b[0] + node[t + 1]
            b.insert(0, np.array([np.logaddexp(y[0] + move[a, 0], y[1] + move[a, 1]) for a in (0, 1)]))
        z = np.logaddexp(*f[-1])
        for t in range(n - 1):
            pairs += np.exp(f[t][:, None] + move + node[t + 1] + b[t + 1] - z)
        logit += [float((x + y)[1] - (x + y)[0]) for x, y in zip(f, b)]
        total += z
        at += n
    return np.array(logit), pairs, total


@pytest.mark.parametrize("run", [1, 2, 7, 512])
def test_long_chains_in_runs(monkeypatch, run):
    monkeypatch.setattr(quality, "RUN", run)
    rng = np.random.default_rng(run)
    sizes = np.array([1, 40, 2, 7, 8, 14, 1, 600 if run > 1 else 30, 15])
    score, move = rng.normal(size=sizes.sum()) * 3, rng.normal(size=(2, 2)) * 2
    for got, want in zip(quality.marginals(score, move, sizes), by_loop(score, move, sizes)):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_a_text_of_200000_lines():
    rng = np.random.default_rng(1)
    sizes = np.array([200_000, 3, 5])
    score = rng.normal(size=sizes.sum())
    quality.marginals(score, np.eye(2), sizes)
    began = time.perf_counter()
    logit, _, _ = quality.marginals(score, np.eye(2), sizes)
    assert time.perf_counter() - began < 1.5  # 6.5 s line by line
    tail = quality.marginals(score[199_000:200_000], np.eye(2), np.array([1000]))[0]
    assert np.allclose(logit[199_500:200_000], tail[500:])


def test_edges(spark):
    rows = [(1, None, "s", "i", 0), (None, "", "s", "i", 0), (2, "a\n" * 3000, "s", "i", 0), (2, "a\n" * 3000, "s", "i", 0), (3, "x" * 50_000, "s", "i", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    nothing = quality.train(docs, labels([]))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {1.0}
    assert not quality.train(docs, labels([(1, 1), (2, 1), (3, None)])).ready
    model = quality.train(docs, labels([(1, 1), (2, 0), (3, 1), (3, 1), (3, 0), (None, 0)]))
    out = quality.scored(docs, model)
    assert model.ready and set(out.columns) == set(docs.columns) and all(0 <= r.score <= 1 for r in out.collect())
    assert quality.scored(docs.where("false"), model).count() == 0
