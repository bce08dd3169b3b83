"""Importance resampling against plain Python with zlib."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import resampling

DOCS = "doc_id long, text string, weight long, score int, rank string"


def features(text, run=3):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return w, [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = (np.bincount([b for x in texts for b in features(x)[1]], minlength=10_000).astype(float) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: 5 * len(able) // 100]
    ranked = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    for r in drawn:
        out.remove(r)
    return sorted(ranked + [(*r[:4], None) for r in out], key=str)


def test_runs_are_crc32_of_their_bytes():
    rng = random.Random(3)
    parts = ["a", "B", "é", " ", "\n", "Z9", "x" * 10, "x" * 63, "y" * 64, "z" * 65, "w" * 700, "-", "\0", " ", "漢"]
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))).encode() for _ in range(rng.randint(0, 6))]
        sizes, found, of = resampling.run_buckets(texts)
        for i, t in enumerate(texts):
            w, want = features(t.decode())
            assert sizes[i] == len(w) and np.concatenate([f[o == i] for f, o in zip(found, of)]).tolist() == want


@pytest.mark.parametrize("partitions", [1, 9])
def test_hostile_documents(spark, partitions):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Mill", "é" * rng.randint(1, 40), "x" * rng.randint(1, 90), "42", "a-b"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60])))) for i in range(400)]
    docs += [(None, docs[7][1]), (None, None), (7, docs[7][1]), (7, docs[7][1]), (900, ""), (901, "the mill " * 40_000), (902, "word" * 50_000), *[(1000, "same text " * 15)] * 30]
    target = ["the Mill 42", None, "", "x y z " * 30]
    got = resampling.resampled(spark.createDataFrame([(*d, 1, 2, "r") for d in docs], DOCS).repartition(partitions), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, max(r.rank or 0 for r in got) + 1))


def test_empty(spark):
    docs, target = spark.createDataFrame([(1, "a b " * 20, 1, 2, "r")], DOCS), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resampled(docs.where("false"), target).count() == 0
    assert [tuple(r) for r in resampling.resampled(docs, target.where("false")).collect()] == brute([(1, "a b " * 20)], [])


def test_share_is_drawn_towards_the_target(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["sun", "moon", "star"] if i % 10 == 0 else ["tax", "form", "file", "sun"]) for _ in range(30))) for i in range(1000)]
    got = resampling.resampled(spark.createDataFrame([(*d, 1, 2, "r") for d in docs], DOCS), spark.createDataFrame([("moon star sun moon star sun",)], "text string"))
    drawn = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 50 and all(d % 10 == 0 for d in drawn)
