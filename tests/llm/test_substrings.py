"""Substring dedup against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import substrings

DOCS = "doc_id long, text string, key string, spans int, s int"


def plain(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in docs], plain([t for _, t in docs])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op9_substrings(spark, sf).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 1000


@pytest.mark.parametrize("seed,window,grams,most,shard", [(1, 5, (2,), 1000, 50), (2, 5, (2, 3, 4), 3, 10**6), (3, 3, (3,), 10, 10), (4, 8, (1, 4), 2, 200), (5, 1, (1,), 2, 5)])
def test_random(spark, seed, window, grams, most, shard):
    """Small alphabets: overlaps, periods, repeats inside one text, borders in all combinations; with tiny limits too."""
    rng = random.Random(seed)
    passage = [rng.choice("abcdefgh") for _ in range(12)]
    texts = [None, "", "  ", "a", "a " * 60, "a b " * 40]
    for _ in range(120):
        w = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") * rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            i, j = sorted(rng.sample(range(13), 2))
            at = rng.randint(0, len(w))
            w[at:at] = passage[i:j]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += texts[10:20]
    df = spark.createDataFrame([(i % 100, t, "k", 1, 2) for i, t in enumerate(texts)], DOCS).repartition(4)
    got = Counter((r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(df, window=window, grams=grams, most=most, shard=shard).collect())
    assert got == Counter(plain(texts, window))


def test_words_that_bad_hashes_confuse(spark):
    """Words that differ in a trailing NUL, and a long Thue-Morse word and its complement, are different words."""
    head = [f"w{i}" for i in range(34)]
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    lists = [[f"{i}{w}" for w in head] + [x] for i, pair in enumerate((("cat\0", "dat"), ("x\0", "y"), (thue, thue.translate({97: "b", 98: "a"})), ("same", "same"))) for x in pair]
    df = spark.createDataFrame([(i, " ".join(w), "k", 1, 2) for i, w in enumerate(lists)], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(df).collect()}
    assert got == {i: (35, 35 if i > 5 else 0) for i in range(8)}
    words = ["a" if i.bit_count() % 2 else "b" for i in range(2048)]  # a sequence of words that polynomials modulo 2**64 confuse
    other = ["b" if w == "a" else "a" for w in words]
    df = spark.createDataFrame([(i, " ".join(w), "k", 1, 2) for i, w in enumerate((words, other))], DOCS)
    got = Counter((r.n_words, r.n_removed, r.kept_sha256) for r in substrings.without_repeats(df).collect())
    assert got == Counter(plain([" ".join(words), " ".join(other)]))


def test_empty(spark):
    assert substrings.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_automaton():
    a = substrings.SuffixAutomaton()
    for s in ("abcbc", "bcb"):
        a.add(s)
    a.finish()
    assert list(a.statistics("abcbc")) == [0, 1, 2, 3, 2]
