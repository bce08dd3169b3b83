"""Near-duplicate groups and the pipeline's stages against brute force."""

import random

import corpus_pipeline

from siltstone.llm import contamination, mixing, neardup, quality

DOCS = "doc_id long, text string, lang string, source string, key int, root string"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(docs, least=0.8):
    """Root of each (doc_id, text): the first in order; links by exact similarity, or equal words."""
    sets = [(shingles(t), tuple((t or "").encode().lower().split())) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            (a, x), (b, y) = sets[i], sets[j]
            if x == y or a and b and len(a & b) >= least * len(a | b):
                u, v = sorted((find(i), find(j)))
                label[v] = u
    return [find(i) for i in range(len(docs))]


def edited(rng, words, share):
    w = list(words)
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return w


def test_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "x " * 30_000)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([6, 30, 80, 300]))]
        docs += [(len(docs) + i, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.05, 0.3])))) for i in range(rng.choice([1, 1, 2, 4]))]
    base = [word() for _ in range(150)]
    docs += [(len(docs) + i, " ".join(edited(rng, base, 0.015))) for i in range(150)]
    df = spark.createDataFrame([(*d, "x", "s", 1, "r") for d in docs], DOCS)
    got = {r.doc_id: r.root for r in neardup.groups(df)[0].collect()}
    want = brute_groups(docs)
    first = {}
    mine = [first.setdefault(got[i], i) for i, _ in docs]
    assert mine == want
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(mine)


def test_lone_pairs_at_the_threshold(spark):
    """Every lone pair is grouped, from exactly 0.8 on; all share a common passage. Below 0.8 none is."""
    rng = random.Random(8)
    passage, docs, want = [f"p{i}" for i in range(40)], [], []
    for n in range(240):
        words = [*(f"w{rng.randrange(10**6)}" for _ in range(229 - 40 * (n % 2))), *passage[: 40 * (n % 2)]]
        other, edits = list(words), 3 + n % 4
        for i in range(edits):
            other[10 + 25 * i] = "edit"
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        a, b = shingles(docs[-2][1]), shingles(docs[-1][1])
        want.append(5 * len(a & b) >= 4 * len(a | b))
    df = spark.createDataFrame([(i, t, "en", "s", 1, "r") for i, t in docs], DOCS)
    got = {r.doc_id: r.root for r in neardup.groups(df)[0].collect()}
    assert [got[2 * n] == got[2 * n + 1] for n in range(240)] == want and want.count(True) == 180
    assert len(set(got.values())) == 480 - 180


def test_repeats_and_nulls(spark):
    rows = [(None, "a b c", "x", None, 1, "r"), (7, "a b c", "x", "s", 1, "r"), (7, "a b c", "y", "s", 2, "r"), (8, None, "x", "s", 1, "r"), (8, "z y x w v u", None, "s", None, None)]
    got = {(r.doc_id, r.text) for r in neardup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(7, "a b c"), (8, None), (8, "z y x w v u")}
    assert neardup.deduplicated(spark.createDataFrame(rows, DOCS)).count() == 3
    assert neardup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_words_that_bad_hashes_confuse(spark):
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    texts = ["cat\0", "dat", "a\0", "b", thue, thue.translate({97: "b", 98: "a"}), "\0"]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "r") for i, t in enumerate(texts)], DOCS)
    assert neardup.deduplicated(df).count() == len(texts)


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "en", ["a", "b", None][i % 3], i, "r") for i in range(90)], DOCS)
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_stages(spark, sf):
    """Each stage on what the one before kept, against its own brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.cache()
        docs = stage(spark, before, sf).cache()
        assert docs.columns == names
        seen[name] = before, docs
    rows = lambda df: [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]
    before, after = seen["quality"]
    scores = {r.doc_id: r.score for r in quality.scored(before, quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {i for i, _ in rows(after)} == {i for i, s in scores.items() if s >= 0.3}
    before, after = seen["near_dedup"]
    kept = rows(before)
    assert {i for i, _ in rows(after)} == {kept[r][0] for r in brute_groups(kept)}
    before, after = seen["decontaminate"]
    hit = {r.doc_id for r in contamination.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {i for i, _ in rows(after)} == {i for i, _ in rows(before)} - hit
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() and sorted(r.start for r in last)[0] == 0
    assert max(r.start + r.n_tokens for r in last) == sum(r.n_tokens for r in last)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, last))


def test_stages_on_hostile_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, root string, copies int, size string, row string"
    extra = (None, "r", 3, "s", "w")
    rows = [(None, None, None, None, None, *extra)] * 2 + [(1, "", "en", None, 0, *extra), (2, "a b c d e f", None, "s", 11, *extra), (2, "a b c d e f", None, "s", 11, *extra)]
    rows += [(3, "word " * 60_000, "en", "s", 1, *extra), (4, "x" * 200_000, "en", "t", 1, *extra), (None, "only text here", "en", "t", 1, *extra)]
    df = spark.createDataFrame(rows, names)
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not there at all in any text"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (df, df.where("false")):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.mode("overwrite").parquet(f"{tmp_path}/in{i}")
            docs = stage(spark, spark.read.parquet(f"{tmp_path}/in{i}"), str(tmp_path))
            if name != "tokenize":
                assert docs.columns == df.columns
        docs.collect()
