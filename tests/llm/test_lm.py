"""Context-tree weighting and the unigram against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import lm

DOCS = "doc_id long, text string, row long, base string, held_out int"


def plain_ctw(train, texts, depth):
    """Sequence probabilities by recursion over explicit context nodes; every context met is a node."""
    counts = defaultdict(Counter)
    for t in train:
        s = b"\n" * depth + t.lower() + b"\xff"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[s[i - d : i]][s[i]] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    def bits(c, level, prefix):
        z = sum(n for b, n in c.items() if b >> (8 - level) == prefix and not b >> (7 - level) & 1)
        o = sum(n for b, n in c.items() if b >> (8 - level) == prefix and b >> (7 - level) & 1)
        return z, o

    def log_w(c, level, prefix):
        own = kt(*bits(counts[c], level, prefix))
        if len(c) == depth:
            return own
        below = sum(log_w(x, level, prefix) for x in list(counts) if len(x) == len(c) + 1 and x[1:] == c)
        return np.logaddexp(own, below) - math.log(2)

    def predict(past, c, level, prefix):
        z, o = bits(counts[c], level, prefix)
        own = (o + 0.5) / (z + o + 1)
        if len(c) == depth:
            return own
        stop = math.exp(kt(z, o) - math.log(2) - log_w(c, level, prefix))
        longer = past[-len(c) - 1 :]
        return stop * own + (1 - stop) * predict(past, longer, level, prefix)

    out = []
    for t in texts:
        s, total = b"\n" * depth + t.lower() + b"\xff", 0.0
        for i in range(depth, len(s)):
            for level in range(8):
                p = predict(s[:i], b"", level, s[i] >> (8 - level))
                total += math.log10(p if s[i] >> (7 - level) & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("depth,common", [(1, 21), (2, 4), (3, 0), (5, 3), (6, 2)])
def test_model_is_ctw(spark, depth, common):
    """Against recursion, with every key broadcast, some, and none."""
    train = [b"abracadabra", b"Abra cad", b"", "éa b".encode(), b"ababab"]
    texts = [b"abra", b"", b"zzz a", "é".encode(), b"ABAB"]
    rows = [(i, x.decode(), 0, "b", int(i >= len(train))) for i, x in enumerate(train + texts)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, DOCS).repartition(3), lm.F.col("held_out") == 1, depth=depth, common=common).collect()}
    assert [got[i].score for i in range(len(rows))] == pytest.approx(plain_ctw(train, train + texts, depth), rel=1e-9)
    assert all(got[i].n_bytes == len(x) + 1 and got[i].bits_per_byte == pytest.approx(-got[i].score / math.log10(2) / (len(x) + 1)) for i, x in enumerate(train + texts))


def test_words_that_bad_hashes_confuse(spark):
    rows = [(1, "x dat", 0, "b", 0), (2, "x cat\0", 0, "b", 1)]
    got = {r.doc_id: r.n_known for r in lm.score(spark.createDataFrame(rows, DOCS), lm.F.col("held_out") == 1).collect()}
    assert got == {1: 3, 2: 2}


def test_table(spark, sf):
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm.op6_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    held = [r for r in got if r.held_out]
    size = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert -sum(r.score for r in held) / sum(size[r.doc_id] + 1 for r in held) / math.log10(2) < 3  # bits a byte


def test_edges(spark):
    rows = [(1, None, 1, "b", 1), (1, None, 1, "b", 1), (None, "a b", 1, "b", 1), (2, "x" * 100_000, 1, "b", 1), (3, "", 1, "b", 1), (4, "A a", 1, "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = lm.score(df, lm.F.col("held_out") == 0).collect()
    assert len(got) == 6 and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert {r.doc_id: r.n_tokens for r in got} == {1: 1, None: 3, 2: 2, 3: 1, 4: 3}
    assert next(r for r in got if r.doc_id == 4).n_known == 3
    assert lm.score(df.where("false"), lm.F.col("held_out") == 0).count() == 0
    alone = lm.score(df, lm.F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in alone)
