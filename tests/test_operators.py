"""Invariants and hand-made cases of the operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import text, vectors
from siltstone.operators import audits, judging, labels, lists, losses, metrics, mining, mixture, shards, topk
from siltstone.sources import readers, restart, sinks

CAND = "split string, query_id long, document_id long, score double"


def cands(spark, rows, more=""):
    return spark.createDataFrame(rows, CAND + more)


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_similarity_join_is_exact_whatever_the_blocks(spark):
    rng = np.random.default_rng(0)
    q, d = rng.normal(size=(30, 12)), rng.normal(size=(200, 12))
    d[7] = d[3]  # a tie
    qs = spark.createDataFrame([(f"s{i % 2}", i, v.tolist()) for i, v in enumerate(q)] + [("s0", 99, None)], "split string, query_id long, v array<double>")
    ds = spark.createDataFrame([(f"s{i % 2}", i, v.tolist()) for i, v in enumerate(d)] + [("s0", 999, None)], "split string, document_id long, v array<double>").repartition(7)
    for tokens in (1, 3):
        s = (q.reshape(-1, 12 // tokens) @ d.reshape(-1, 12 // tokens).T).reshape(30, tokens, 200, tokens).max(3).sum(1)
        want = {i: sorted((-round(s[i, j], 9), j) for j in range(200) if j % 2 == i % 2)[:9] for i in range(30)}
        for most in (10**9, 3000, 1):
            got = topk.similarity_topk(qs, ds, 9, tokens, most=most).collect()
            assert sorted((r.query_id, r["rank"], r.document_id) for r in got) == sorted((i, k + 1, j) for i, w in want.items() for k, (_, j) in enumerate(w))
    assert topk.similarity_topk(qs, ds, 2, within_split=False).count() == 60
    assert topk.similarity_topk(qs.where("false"), ds, 2).count() == 0
    assert topk.similarity_topk(qs, ds.where("false"), 2, most=3000).count() == 0
    unsplit = [df.withColumn("split", F.when(F.col("split") == "s1", "s1")) for df in (qs, ds)]  # s0 becomes null, a split like any other
    for within in (True, False):
        few, many = (sorted((r.query_id, r["rank"], r.document_id) for r in topk.similarity_topk(*unsplit, 4, within_split=within, most=most).collect()) for most in (10**9, 3000))
        assert few == many and len(few) == 120


def test_shard_merges_agree(spark):
    rng = random.Random(1)
    rows = [("a", q, d, round(rng.random(), 2)) for q in range(5) for d in range(60)]
    whole = topk.ranked(cands(spark, rows), 20)
    for n in (1, 3, 100):
        cut = cands(spark, [(*r, r[2] % n) for r in rows], ", shard int")
        assert ids(topk.merged(cut, 20), "query_id", "document_id", "rank") == ids(whole, "query_id", "document_id", "rank")
        assert ids(topk.merged_best(cut.union(cut.withColumn("shard", F.lit(n))), 20), "query_id", "document_id", "rank") == ids(whole, "query_id", "document_id", "rank")
    bad = cands(spark, [("a", 1, -1, 1.0), ("a", 1, 2, float("nan")), ("a", 1, 3, float("-inf")), ("a", 1, 4, None), ("a", 1, 5, 0.5)])
    assert ids(topk.valid(bad), "document_id") == [(5,)]


@pytest.mark.parametrize("n,s", [(10, 3), (3, 7), (1, 1), (12, 4), (0, 2)])
def test_shard_bounds(spark, n, s):
    df = spark.createDataFrame([("a", i) for i in range(n)], "split string, id long")
    per = math.ceil(n / s) if n else 1
    assert ids(shards.contiguous(df, "id", s), "id", "shard") == [(i, i // per) for i in range(n)]
    assert ids(shards.strided(df, "id", s), "id", "shard") == [(i, i % s) for i in range(n)]
    assert ids(shards.proportional(df, "id", s), "id", "shard") == [(i, next(k for k in range(s) if n * k // s <= i < n * (k + 1) // s)) for i in range(n)]
    sizes = [r["count"] for r in shards.bounded(df, "id", 4).groupBy("shard").count().collect()]
    assert all(x <= 4 for x in sizes) and sum(sizes) == n


def test_numbering_over_many_ranges(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else "ab"[i % 2], i % 50, i) for i in range(400)], "split string, k long, id long").repartition(9)
    for by in ((), ("split",)):
        got = shards.numbered(df, "k", "id", by=by).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.split if by else 0, []).append(r)
        for g in groups.values():
            assert [r["at"] for r in sorted(g, key=lambda r: (r.k, r.id))] == list(range(len(g))) and {r.n for r in g} == {len(g)}


def test_labels(spark):
    raw = spark.createDataFrame([("a", 1, [5, 6]), ("a", 1, []), ("a", 1, None), ("a", 2, [7])], schema.LABELS)
    assert ids(labels.first_element(raw), "query_id", "document_id") == [(1, 5), (2, 7)]
    pos = spark.createDataFrame([("a", 1, 9, 1), ("a", 1, 9, 2), ("a", 1, 8, 3), ("a", 1, 7, 4)], "split string, query_id long, document_id long, label_pos int")
    assert ids(labels.distinct_positives(pos), "document_id", "label_pos") == [(7, 3), (8, 2), (9, 1)]
    assert ids(labels.capped_gold(pos, 3), "document_id") == [(8,), (9,), (9,)]
    docs = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], schema.DOCUMENTS)
    got = labels.looked_up(spark.createDataFrame([("a", 1), ("a", 2)], "split string, document_id long"), docs)
    assert sorted((r.document_id, r.document) for r in got.collect()) == [(1, "x"), (2, None)]


def test_mining_skips_and_drops_whole_queries(spark):
    c = cands(spark, [("a", q, d, 1 - d / 100) for q in (1, 2) for d in range(10 - q)])
    pos = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, 50, 1), ("a", 3, 1, 1)], "split string, query_id long, document_id long, label_pos int")
    assert ids(mining.mined_negatives(c, pos, 2, 6), "query_id", "document_id", "neg_rank") == [(1, d, d - 2) for d in range(3, 9)] + [(2, d, d - 1) for d in range(2, 8)]
    got = {r["split"]: r.asDict() for r in mining.pair_stats(c, pos, 2, 7).collect()}["a"]
    assert (got["pairs_written"], got["pairs_dropped_short_of_k"], got["queries_without_candidates"]) == (0, 2, 1)
    q = spark.createDataFrame([("a", 1, "old"), ("a", 1, "text")], schema.QUERIES)
    pairs = mining.mined_pairs(c, pos, q, 2, 6).collect()
    assert sorted((r.query_id, r.query, r.negative_ids) for r in pairs) == [(1, "text", list(range(3, 9))), (2, "", list(range(2, 8)))]


def test_ablation_drops_queries_with_a_positive_in_the_cut(spark):
    rank = topk.ranked(cands(spark, [("a", q, d, 1 - d / 10) for q in (1, 2) for d in range(8)]))
    pos = spark.createDataFrame([("a", 1, 0, 1), ("a", 2, 7, 1)], "split string, query_id long, document_id long, label_pos int")
    q = spark.createDataFrame([("a", 1, "t"), ("a", 2, "t")], schema.QUERIES)
    rows = mining.ablation_pairs(rank, rank, pos, q, 5)
    assert {r.query_id for r in rows.collect()} == {2}
    packed = mining.arm_lists(rows).first()
    assert packed.negative_ids == [0, 1, 2, 3, 4] * 2 and packed.negative_sources == ["mv"] * 5 + ["dense"] * 5


def judged(spark, rows):
    return spark.createDataFrame(rows, "split string, query_id long, positive_id long, positive_score double, document_id long, score double")


def test_veto_band_and_risk(spark):
    near = [("a", 1, 0, 1.0, d, 0.99 - d / 1000) for d in range(1, 10)]
    rows = near + [("a", 1, 0, 1.0, 90, 1.0), ("a", 1, 0, 1.0, 91, 1.5)]
    rows += [("a", 2, 0, 1.0, d, 0.5 - d / 100) for d in range(8)] + [("a", 3, 0, 1.0, d, 0.5) for d in range(6)]
    rows += [("a", 4, 0, -1.0, d, -2.0 - d) for d in range(9)]
    j = judged(spark, rows)
    risk = {r["split"]: r for r in judging.veto_risk(j, spark.createDataFrame([("a",), ("z",)], "split string")).collect()}
    assert (risk["a"].judged_pairs, risk["a"].candidates, risk["a"].vetoed) == (4, 34, 2) and risk["z"].risk == 0
    pool = {}
    for r in judging.band_pool(j, 7, 0.97).collect():
        pool.setdefault(r.query_id, []).append((r.pool_rank, r.document_id))
    assert sorted(pool[1]) == [(i, i) for i in range(1, 10)]  # all nine in the band
    assert sorted(pool[2]) == [(i + 1, i) for i in range(7)]  # none: the seven best
    assert 3 not in pool and len(pool[4]) == 7
    assert all(r.pool_size >= 7 for r in judging.usable_pairs(judging.band_pool(j, 7, 0.97)).collect())
    wide = judging.usable_pairs(judging.band_pool(j, 7, unfiltered=True)).collect()
    assert {r.query_id: r.pool_size for r in wide} == {1: 11, 2: 8, 4: 9}


def test_pool_gates_and_latest(spark):
    keys = spark.createDataFrame([("a", 1), ("a", 2)], "split string, query_id long")
    row = "split string, query_id long, document_id long, rank int"
    gold, cand = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 6, 1)], row), spark.createDataFrame([("a", 1, d, d) for d in range(10, 15)] + [("a", 2, d, d) for d in range(4)], row)
    pool = judging.judged_pool(keys, gold, cand, lambda r: r.withColumn("judge_score", F.lit(1.0)))
    assert {r.query_id for r in pool.collect()} == {1} and pool.count() == 6
    parts = spark.createDataFrame([("a", 1, 0), ("a", 1, 2), ("a", 1, 2), ("a", 2, 1)], "split string, query_id long, shard int")
    assert ids(judging.latest(parts), "query_id", "shard") == [(1, 2), (1, 2), (2, 1)]


def test_targets_and_sampling(spark):
    usable = spark.createDataFrame([(s, q, 0) for s, n in (("a", 40), ("b", 10), ("c", 1)) for q in range(n)], "split string, query_id long, positive_id long")
    risk = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.9), ("d", 0.0)], "split string, risk double")
    t = mixture.targets(usable, risk, 47)
    goal = {r["split"]: r.target for r in t.collect()}
    assert sum(goal.values()) == 47 and goal["d"] == 0
    rows = mixture.sampled(usable, t)
    got = rows.groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {k: v for k, v in goal.items() if v}
    assert ids(rows, "split", "query_id", "copy_no") == ids(mixture.sampled(usable.repartition(5), t), "split", "query_id", "copy_no")
    assert rows.where("split = 'b' and copy_no = 0").count() == 10  # over its rows: each once at least
    with pytest.raises(Exception, match="no usable rows"):
        mixture.targets(usable.where("false"), risk, 10).collect()


def test_training_rows(spark, tmp_path):
    pool = judged(spark, [("a", 1, 0, 1.0, d, 0.5) for d in range(9)]).select("split", "query_id", "positive_id", "document_id")
    rows = spark.createDataFrame([("a", 1, 0, c) for c in range(30)], "split string, query_id long, positive_id long, copy_no long")
    sft = mixture.training_rows(rows, pool)
    per = sft.groupBy("copy_no").agg(F.count_distinct("document_id").alias("n"), F.collect_set("document_id").alias("s")).collect()
    assert len(per) == 30 and all(r.n == 7 for r in per) and len({tuple(sorted(r.s)) for r in per}) > 1
    docs = spark.createDataFrame([("a", d, "t" if d else "") for d in range(9)], schema.DOCUMENTS)
    assert mixture.with_texts(sft, docs).count() == 0  # the positive has no text
    wide = mixture.wide(sft, ["split", "query_id", "positive_id", "copy_no"], 7)
    assert readers.negatives(wide) == [f"negative_{i}" for i in range(1, 8)]
    sinks.write_sources(wide, str(tmp_path))
    back = readers.read_training(spark, str(tmp_path))
    assert back.count() == 30 and {r.source for r in back.collect()} == {"a"}


def test_triples(spark):
    scored = spark.createDataFrame([(r, n, 5, (n if r else 9)) for r in range(3) for n in range(12)], "row_id long, neg_no long, pos_score long, neg_score long")
    v = mixture.vetoed_triples(scored, 5)
    goal = mixture.triple_target(v).first()
    assert (goal.usable, goal.negatives_in, goal.negatives_vetoed, goal.short) == (2, 36, 26, 1)
    assert goal.target == round(31979 * (2**0.5 * (1 - 26 / 36)) / (3672**0.5 * (1 - 0.2075)))
    up = mixture.upsampled_triples(v, spark.createDataFrame([(5, 2)], "target long, usable long"), 5)
    assert sorted((r.cycle, r.row_id) for r in up.select("cycle", "row_id").distinct().collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]
    assert mixture.upsampled_triples(v.where("false"), spark.createDataFrame([(5, 0)], "target long, usable long"), 5).count() == 0
    plan = mixture.batch_plan(spark.createDataFrame([("a" if i < 25 else "b", i) for i in range(40)], "source string, id long"), "source", ["id"], 10)
    assert sorted({(r.source, r.batch_order) for r in plan.collect()}, key=str).__len__() == 5


def test_lists(spark):
    pool = spark.createDataFrame([("a", 1, "gold", 5, 2, 0.1), ("a", 1, "gold", 6, 1, float("nan")), ("a", 1, "gold", 7, 3, 0.9)] + [("a", 1, "cand", 10 + d, d, d / 10) for d in range(4)] + [("a", 1, "cand", 20, 9, float("inf")), ("a", 1, "cand", 21, 9, None), ("a", 1, "cand", 22, 9, float("nan"))] + [("a", 2, "cand", 1, 1, 0.1)], "split string, query_id long, section string, document_id long, rank int, judge_score double")
    index = spark.createDataFrame([("a", 3)], "split string, split_index long")
    got = lists.candidate_lists(pool, index, 5)
    base = 3 * shards.NAMESPACE
    assert lists.packed(got).first().document_ids == [base + d for d in (5, 7, 13, 12, 11)]
    assert lists.packed(got).first().scores == [0.0] * 5
    assert lists.candidate_lists(pool, index, 7).count() == 0
    stats = lists.list_stats(pool, got).first()
    assert (stats.rows, stats.dropped_short, stats.documents) == (1, 1, 5)


def test_losses(spark):
    rng = np.random.default_rng(0)
    t, s = rng.normal(size=(6, 8)), rng.normal(size=(6, 8))
    df = spark.createDataFrame([(i, t[i].tolist(), s[i].tolist()) for i in range(6)], "id long, teacher array<double>, student array<double>")
    mm = lambda x: (x - x.min(1, keepdims=True)) / (x.max(1, keepdims=True) - x.min(1, keepdims=True) + 1e-8)
    ls = lambda x: x - np.log(np.exp(x).sum(1, keepdims=True))
    a, b = mm(t), mm(s)
    kl = (np.exp(ls(a / 0.3)) * (ls(a / 0.3) - ls(b / 0.3))).sum(1).mean()
    y = a.argmax(1)
    logits = b / 0.05
    masked = np.where((a > 0.6) & (np.arange(8) != y[:, None]), -np.inf, logits)
    nce = (np.log(np.exp(masked).sum(1)) - logits[np.arange(6), y]).mean()
    got = losses.mixed_loss(df).first()
    assert (got.n, got.kl, got.nce) == (6, pytest.approx(kl), pytest.approx(nce)) and got.loss == pytest.approx(kl + 0.1 * nce)
    cut = np.clip(t, np.quantile(t, 0.1, axis=1, keepdims=True), np.quantile(t, 0.9, axis=1, keepdims=True))
    by_hand = spark.createDataFrame([(cut[i].tolist(), s[i].tolist()) for i in range(6)], "teacher array<double>, student array<double>")
    assert losses.mixed_loss(df, clip_pct=0.1).first().loss == pytest.approx(losses.mixed_loss(by_hand).first().loss) != got.loss
    summed = losses.mixed_loss(df, size_average=False).first()
    assert (summed.kl, summed.nce) == (pytest.approx(got.kl * got.n), pytest.approx(got.nce))
    same = losses.mixed_loss(df.withColumn("student", F.col("teacher")), w_nce=0.0).first()
    assert same.loss == pytest.approx(0, abs=1e-12)
    q = losses.row_quantiles(df, "id", "teacher", 0.1).orderBy("id").collect()
    assert [r.low for r in q] == pytest.approx(np.quantile(t, 0.1, axis=1)) and [r.high for r in q] == pytest.approx(np.quantile(t, 0.9, axis=1))


def test_metrics(spark):
    qrels = spark.createDataFrame([("d", "q", str(i), 1 + (i == 0)) for i in range(3)] + [("d", "p", "0", 1)], "dataset string, query_id string, doc_id string, rel int")
    perfect = spark.createDataFrame([("d", "q", str(i), i + 1) for i in range(3)] + [("d", "p", "0", 1)], "dataset string, query_id string, doc_id string, rank int")
    m = metrics.ir_metrics(perfect, qrels).first()
    assert (m.ndcg_10, m.ndcg_100, m.recall_10, m.map, m.mrr_10, m.precision_10) == (1, 1, 1, 1, 1, 0.2)
    worst = metrics.ir_metrics(perfect.where("false"), qrels).first()
    assert worst.ndcg_10 == worst.map == worst.mrr_10 == 0
    run = spark.createDataFrame([("d", "7", "7", 1), ("d", "7", "8", 2)], "dataset string, query_id string, doc_id string, rank int")
    assert [(r.doc_id, r["rank"]) for r in metrics.without_self(run).collect()] == [("8", 1)]
    res = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("x", 0.0)], "dataset string, ndcg_10 double")
    assert metrics.macro(res, ["a", "b"]).first().macro_ndcg_10 == 0.75
    later = spark.createDataFrame([("a", 0.9), ("c", 0.1)], "dataset string, ndcg_10 double")
    assert ids(metrics.resumed(res, later), "dataset", "ndcg_10") == [("a", 0.5), ("b", 1.0), ("c", 0.1), ("x", 0.0)]


def test_audits(spark):
    rows = [("a", 1, 9, s, r, r + (20 if s == "mv" else 21), 0.1 * r, 0.15) for s in ("mv", "dense") for r in (1, 2)] + [("a", 2, 9, "mv", 1, 1, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "split string, query_id long, positive_id long, source string, neg_rank int, document_id long, score double, positive_score double")
    r = audits.mining_audit(df, 2).first()
    assert (r.n, r.mv_false_negative_rate, r.set_overlap) == (1, 0.5, 0.5)
    g = audits.gate_audit(spark.createDataFrame([("a", 1.0, [0.5, 1.5]), ("a", 1.0, [0.5, 1.0])], "split string, pos double, neg array<double>")).first()
    assert (g.rows, g.fn_rate, g.pos_at_1, g.margin) == (2, 0.25, 0.0, -0.25)


def test_text_and_vectors(spark):
    df = spark.createDataFrame([("T", " a b "), ("", " a b "), (None, None)], "title string, text string")
    assert [r.x for r in df.select(text.titled(F.col("title"), F.col("text")).alias("x")).collect()] == ["T  a b", " a b ", ""]
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = v.select(vectors.l2_normalized(F.col("a")).alias("a"), vectors.l2_normalized(F.col("z")).alias("z")).first()
    assert r.a == [0.6, 0.8] and r.z == [0.0, 0.0]
    q = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(-1.0)))
    d = F.array(F.array(F.lit(0.5), F.lit(0.5)))
    r = v.select(vectors.maxsim(q, d).alias("m"), vectors.maxsim(q, d, True).alias("c"), vectors.meanmaxsim(q, d).alias("a")).first()
    assert (r.m, r.c, r.a) == (0.0, 0.5, 0.0)


def test_files(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "x")], "document_id long, document string").coalesce(1).write.parquet(f"{root}/raw")
    import shutil

    (tmp_path / "documents").mkdir()
    part = next((tmp_path / "raw").glob("*.parquet"))
    shutil.copy(part, tmp_path / "documents" / "fiqa-000.parquet")
    assert readers.scan_split(spark, root, "documents", "fiqa").first()["split"] == "fiqa"
    with pytest.raises(FileNotFoundError):
        readers.scan_split(spark, root, "documents", "nq")
    (tmp_path / "pairs.jsonl").write_text('{"query_id": 1, "split": "a", "query": "é", "positive_id": 2, "negative_ids": [3]}\n\n{"query_id": 2, "split": "b"}\n')
    assert ids(readers.read_pairs(spark, f"{root}/pairs.jsonl", ["a"]), "query_id", "query") == [(1, "é")]
    np.savez_compressed(tmp_path / "fiqa_3.npz", qids=np.array([1, 2]), ids=np.array([[4, -1], [5, 6]]), scores=np.array([[0.5, -np.inf], [0.25, 0.125]], np.float32))
    assert ids(readers.read_npz(spark, root), "split", "shard", "query_id", "document_id", "score") == [("fiqa", 3, 1, 4, 0.5), ("fiqa", 3, 2, 5, 0.25), ("fiqa", 3, 2, 6, 0.125)]
    parts = spark.createDataFrame([("a", 0, 1, 2, 0.5), ("b", 1, 1, 2, 0.5)], schema.CANDIDATES)
    assert restart.write_parts(parts, f"{root}/parts") == [("a", 0), ("b", 1)] and not restart.write_parts(parts, f"{root}/parts")
    assert readers.read_parts(spark, f"{root}/parts", "b").count() == 1
    assert sinks.write_jsonl(parts, f"{root}/lines") and readers.read_jsonl(spark, f"{root}/lines").count() == 2


def test_evaluation_sources(spark, tmp_path):
    snap = tmp_path / "set" / "snapshots" / "0002"
    for old in ("0001", "0002"):
        (tmp_path / "set" / "snapshots" / old).mkdir(parents=True)
    (snap / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in ({"_id": 1, "title": "T", "text": "x"}, {"_id": 2, "title": "", "text": " y"})))
    (snap / "queries.jsonl").write_text('{"_id": "q1", "text": "t"}\n{"_id": "q2", "text": "u"}\n')
    spark.createDataFrame([("q1", 1, 2), ("q1", 2, 0)], "`query-id` string, `corpus-id` long, score int").coalesce(1).write.parquet(f"{snap}/raw")
    (snap / "qrels").mkdir()
    next((snap / "raw").glob("*.parquet")).rename(snap / "qrels" / "test-000.parquet")
    found = readers.latest_snapshot(spark, str(tmp_path), "set")
    assert found.endswith("0002") and readers.official_split("msmarco") == "dev" and readers.official_split("fiqa") == "test"
    c, q, r = readers.load_dataset(*[readers.read_kind(spark, found, k, "test") for k in ("corpus", "queries", "qrels")])
    assert ids(c, "doc_id", "text") == [("1", "T x"), ("2", " y")] and ids(q, "query_id") == [("q1",)] and ids(r, "query_id", "doc_id", "rel") == [("q1", "1", 2)]
    with pytest.raises(FileNotFoundError):
        readers.read_kind(spark, found, "nothing", "test")


def test_masked_tokens_have_no_part(spark):
    vec = "array<array<double>>"
    cases = [
        ([[1.0, 0.0], [0.0, 1.0]], [[2.0, 5.0], [3.0, 1.0]], [True, True], [True, False], (7.0, 3.5)),
        ([[1.0, 0.0], [0.0, 1.0]], [[2.0, 5.0], [3.0, 1.0]], [True, False], [True, True], (3.0, 3.0)),
        ([[1.0, 0.0], [0.0, 1.0]], [[2.0, 5.0], [3.0, 1.0]], [None, True], [True], (5.0, 5.0)),
        ([[1.0, 0.0]], [[2.0, 5.0]], [True], [False], (0.0, 0.0)),
        ([[1.0, 0.0]], [[2.0, 5.0]], [False], [True], (0.0, 0.0)),
        ([], [[2.0, 5.0]], [], [True], (0.0, 0.0)),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], f"i int, q {vec}, d {vec}, qm array<boolean>, dm array<boolean>")
    args = [F.col(c) for c in ("q", "d", "qm", "dm")]
    got = df.select("i", vectors.masked_maxsim(*args).alias("s"), vectors.masked_maxsim(*args, mean=True).alias("m")).orderBy("i").collect()
    assert [(r.s, r.m) for r in got] == [c[4] for c in cases]


@pytest.mark.parametrize("most", [10**9, 3000])
def test_topk_is_held_over_a_task(spark, most):
    """What is shuffled is bounded by k x queries x tasks, however many batches a task reads; the result is that of brute force."""
    rng = np.random.default_rng(4)
    q, d = rng.normal(size=(30, 8)).round(1), rng.normal(size=(3000, 8)).round(1)  # rounded: many ties
    qs = spark.createDataFrame([("a" if i % 2 else None, i, v.tolist()) for i, v in enumerate(q)], "split string, query_id bigint, v array<double>")
    ds = spark.createDataFrame([("a" if i % 2 else None, i, v.tolist()) for i, v in enumerate(d)], "split string, document_id bigint, v array<double>").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "50")
        partial = topk.partial_topk(qs, ds, 7, most=most)
        assert partial.count() <= 7 * 30 * (3 if most > 3000 else partial.rdd.getNumPartitions() * 3)
        got = ids(topk.ranked(partial, 7), "query_id", "rank", "document_id")
    finally:
        spark.conf.set(key, before)
    want = []
    for i, v in enumerate(q):
        order = sorted((-round(float(v @ d[j]), 9), j) for j in range(i % 2, 3000, 2))[:7]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(order)]
    assert got == sorted(want)


def test_held_merges_blocks():
    rng = np.random.default_rng(5)
    held, all_ = topk.Held(4, 9), np.zeros((4, 0))
    for i in range(40):
        part = rng.normal(size=(4, 20)).round(1)
        all_ = np.concatenate((all_, part), 1)
        held.add(part[:2], np.arange(20) + 20 * i)
        held.add(part[2:], np.arange(20) + 20 * i, 2)
        if i % 7 == 0:
            held.best()
    row, doc, score = held.best()
    for r in range(4):
        want = sorted((-round(s, 9), j) for j, s in enumerate(all_[r]))[:9]
        assert doc[row == r].tolist() == [j for _, j in want] and score[row == r].tolist() == [-s for s, _ in want]


def test_masks_of_a_skip_list(spark):
    df = spark.createDataFrame([([5, 7, None, 9], [1, 1, 1, 0]), ([7, 5], [1]), ([], []), (None, None)], "ids array<int>, attention array<int>")
    mask = lambda *a: [r[0] for r in df.select(vectors.skiplist_mask(F.col("ids"), *a)).collect()]
    assert mask([7]) == [[True, False, False, True], [False, True], [], None]
    assert mask([7], F.col("attention")) == [[True, False, False, False], [False, False], [], None]
    assert mask([]) == [[True, True, False, True], [True, True], [], None]
    two = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[3.0, 1.0], [4.0, 4.0]])], "q array<array<double>>, d array<array<double>>")
    score = lambda qm: two.select(vectors.masked_maxsim(F.col("q"), F.col("d"), qm, F.array(F.lit(True), F.lit(False)))).first()[0]
    assert score(None) == 5.0 and score(F.array(F.lit(True), F.lit(False))) == 3.0
