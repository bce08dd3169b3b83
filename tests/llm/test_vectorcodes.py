"""Vector codes against full searches in plain Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import vectorcodes

VEC = "vec_id long, embedding array<double>, label int, code string, v int"


@pytest.mark.parametrize("seed", range(6))
def test_partial_distances_find_the_nearest(seed):
    """Small values (many ties), large ones (64 bits), one dimension, one entry; thresholds from dense to sparse."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        high = int(rng.choice([2, 4, 100, 20_000, vectorcodes.LIMIT]))
        x, book = (rng.integers(-high, high, (int(rng.integers(1, m)), w)) for w in [int(rng.integers(1, 7))] for m in (50, 65))
        code, far = vectorcodes.nearest(x, book)
        whole = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == whole.argmin(1)).all() and (far == whole.min(1)).all()


def brute(rows, parts, entries, rounds):
    finite = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fits = sorted([r for r in finite if r[1] and len(r[1]) % parts == 0 and all(abs(x) < vectorcodes.LIMIT / 256 for x in r[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fits = [r for r in fits if len(r[1]) == len(fits[0][1])]
    cut = lambda v: [[math.floor(256 * Fraction(x)) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)]
    xs = [cut(r[1]) for r in fits]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(x[p], books[p]) for x in xs]
            for e in range(len(books[p])):
                mine = [x[p] for x, o in zip(xs, of) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]

    def one(r):
        if r not in fits:
            return r[0], None, None
        codes = [near(part, book) for part, book in zip(cut(r[1]), books)]
        return r[0], "".join(f"{c:02x}" for c in codes), sum(far(part, book[c]) for part, book, c in zip(cut(r[1]), books, codes))
    out = [(*one(r), r[2]) for r in finite]
    of_label = lambda label: [e for _, _, e, x in out if x == label and e is not None]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sum(of_label(x)) if of_label(x) else None) for i, c, e, x in out), key=str), digest


@pytest.mark.parametrize("hot", [1000, 2])
def test_hostile_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(vectorcodes, "HOT", hot)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.01, 1, 30])).tolist(), int(rng.integers(0, 4)) or None) for i in range(60)]
    rows += [(2, rows[2][1], 1), (2, rows[2][1], 1), (None, rows[5][1], None), (None, [0.0] * 8, 9), (70, [1.0] * 12, 8), (71, [], 8), (72, [1.0] * 3, 1), (73, [1e30] * 8, 1), (-4, [1.0, math.nan] * 4, 1), (-5, None, 1), (-6, [1.0, None] * 4, 1), (-7, [math.inf] * 8, 1)]
    got = vectorcodes.compressed(spark.createDataFrame([(*r, "x", 1) for r in rows], VEC).repartition(5), parts=4, entries=7).collect()
    want, digest = brute(rows, 4, 7, vectorcodes.ROUNDS)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0], 1, "x", 1), (5, [1.0, 2.0], None, "x", 1)], VEC)
    got = sorted((r.vec_id, r.code, r.error, r.label_error) for r in vectorcodes.compressed(df, parts=2).collect())
    assert got == [(3, "0000", 0, 0), (5, "0000", 0, 0)]
    assert vectorcodes.compressed(df.where("false")).count() == 0
    assert [(r.code, r.error, r.label_error) for r in vectorcodes.compressed(df, parts=3).collect()] == [(None, None, None)] * 2


def test_decoded(spark, sf):
    """What a code stands for is as far from the vector as its error says."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = vectorcodes.trained(vectors)
    kept = vectorcodes.encoded(vectors, books)
    assert set(kept.columns) == {*vectors.columns, "code", "error"}
    rows = vectorcodes.decoded(kept.unionByName(kept.limit(1).withColumn("code", F.lit(None).cast("string"))), books).collect()
    assert sum(r.approximate is None for r in rows) == 1
    for r in rows:
        if r.approximate:
            far = sum((math.floor(256 * x) - math.floor(256 * y)) ** 2 for x, y in zip(r.embedding, r.approximate))
            assert far == r.error
    first = vectorcodes.trained(vectors, rounds=0)
    assert vectorcodes.encoded(vectors, books).agg(F.sum("error")).first()[0] < vectorcodes.encoded(vectors, first).agg(F.sum("error")).first()[0]
