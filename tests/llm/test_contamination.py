"""Decontamination against all windows by brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import contamination

DOCS = "doc_id long, text string, item_id string, start int"


def shingles(w, k=5):
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items, least=0.8):
    out = {}
    for i, t in items:
        w = (t or "").encode().lower().split()
        s = shingles(w)
        for d, x in docs:
            words = (x or "").encode().lower().split()
            k = min(5, len(w))
            if not w or len(words) < k:
                continue
            for at in range(max(1, len(words) - len(w) + 1)):
                span = words[at : at + len(w)]
                win = Counter(tuple(span[j : j + k]) for j in range(len(span) - k + 1))
                shared = sum((s & win).values())
                sim = shared / (sum(s.values()) + sum(win.values()) - shared)
                if sim >= least and sim > out.get((d, i), (0,))[0]:
                    out[d, i] = (sim, at, len(span))
    return out


def test_random(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrs")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 9, 16, 30, 50])))) for i in range(25)] + [(99, None), (98, ""), (97, "A B " * 12)]
    docs = [(0, None), (1, ""), (2, "a b " * 30), (3, "b a " * 5)]
    for d in range(4, 160):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            p = [x.upper() for x in (rng.choice(items)[1] or "").split()] if (d % 9) else []
            for _ in range(rng.randint(0, 3) * (len(p) > 15)):
                p[rng.randrange(len(p))] = word()
            if rng.random() < 0.3:
                p = p[: len(p) - rng.randint(0, 3)]
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, "\n".join(w)))
    items = [x for x in items if x[1] or x[0] in (98, 99)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in contamination.contaminated(df, bench).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and all(np.isclose(got[k][0], want[k][0]) and got[k][2] == want[k][2] for k in want) and len(want) > 50
    clean = contamination.decontaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in contamination.op2_decontamination(spark, sf).collect()}
    within = {(d, i) for d, t in docs for i, x in items if x in t}
    assert within and within <= got


def test_parts_and_alike_words(spark):
    """Many parts of the benchmark give what one gives; words that differ in a NUL are different."""
    items = [(1, " ".join(f"w{i}" for i in range(9)) + " dat"), (2, " ".join(f"v{i}" for i in range(30))), (3, "a b c"), (None, "q r s")]
    docs = [(1, " ".join(f"w{i}" for i in range(9)) + " cat\0"), (2, items[0][1]), (3, "x " + items[1][1] + " y a b c"), (4, "q R s")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert (1, 1) not in want and len(want) == 4
    for part in (1, 70, 10**6):
        assert {(r.doc_id, r.item_id) for r in contamination.contaminated(df, bench, part=part).collect()} == set(want)
        assert [r.doc_id for r in contamination.decontaminated(df, bench, part=part).collect()] == [1]


@pytest.mark.parametrize("which", [0, 1])
def test_empty(spark, which):
    df, bench = spark.createDataFrame([(1, "a", "x", 1)], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    df, bench = (df.where("false"), bench) if which else (df, bench.where("false"))
    assert contamination.contaminated(df, bench).count() == 0
    assert contamination.decontaminated(df, bench).count() == df.count()


def test_a_short_document_meets_items_of_all_lengths(spark):
    """One window, the whole document, stands against items of several numbers of words."""
    words = [f"w{i}" for i in range(60)]
    items = [(n, " ".join(words[:n])) for n in (50, 52, 53, 55, 60)]
    docs = [(1, " ".join(words[:49])), (2, " ".join(words[:48])), (3, " ".join(words[:60]))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_words) for r in contamination.contaminated(df, bench).collect()}
    want = {k: (round(v[0], 9), *v[1:]) for k, v in brute(docs, items).items()}
    assert got == want and len([k for k in want if k[0] == 1]) == 5


def test_many_lengths_and_long_texts():
    """Items of 300 lengths, that share words and passages, in one very long text and in repeated ones."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    items = [(n, " ".join(passage[: n % 40] + [rng.choice(vocabulary) for _ in range(n)])) for n in range(5, 305)]
    index = contamination.Index(items)
    assert len(index.own) > 150
    planted = {20: 17, 4000: 120, 9000: 299}
    words = [rng.choice(vocabulary) for _ in range(20_000)]
    for at, i in planted.items():
        w = items[i - 5][1].split()
        words[at : at + len(w)] = w
    text = " ".join(words).encode()
    got = index.hits([text, b"", text])
    assert got[0] == got[2] and got[1] == {} and {i: got[0][i][1] for i in planted.values()} == {i: at for at, i in planted.items()}
    few = random.Random(9).sample(items, 12) + [items[i - 5] for i in planted.values()]
    part = [(1, " ".join(words[:700])), (2, " ".join(words[8900:9700]))]
    want = brute(part, few)
    found = contamination.Index(few).hits([t.encode() for _, t in part])
    assert {(d + 1, i): (round(s, 9), at, n) for d, hit in enumerate(found) for i, (s, at, n) in hit.items()} == {k: (round(v[0], 9), *v[1:]) for k, v in want.items()} and want
