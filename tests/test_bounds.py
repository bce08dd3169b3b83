"""What a step holds, moves and writes, beside its result."""

import io
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siltstone import schema
from siltstone.operators import audits, metrics, mining, topk
from siltstone.plans import catalog, fixtures
from siltstone.sources import npz, readers, sinks


def vectors(spark, n, key, seed):
    x = np.random.default_rng(seed).normal(size=(n, 8)).round(1)
    return spark.createDataFrame([("ab"[i % 2], i, v.tolist()) for i, v in enumerate(x)], f"split string, {key} bigint, v array<double>")


def test_products_are_bounded(monkeypatch):
    monkeypatch.setattr(topk, "PRODUCT", 4000)
    q, d = np.random.default_rng(1).normal(size=(50, 8)), np.random.default_rng(2).normal(size=(100, 8))
    parts = list(topk._scored(q, d, 2))
    assert len(parts) == 5 and max(s.size for _, s in parts) * 4 <= 4000
    assert np.allclose(np.concatenate([s for _, s in parts]), topk._maxsims(q, d, 2))


def test_query_blocks_are_as_large_as_what_is_held_allows(spark, monkeypatch):
    q, d = vectors(spark, 40, "query_id", 1), vectors(spark, 300, "document_id", 2)
    rows = lambda: sorted((r.split, r.query_id, r["rank"], r.document_id, round(r.score, 9)) for r in topk.similarity_topk(q, d, 9, 2).collect())
    whole, sizes, plain = rows(), [], topk.packed
    monkeypatch.setattr(topk, "packed", lambda df, id_, prefix, n: sizes.append((prefix, n)) or plain(df, id_, prefix, n))
    monkeypatch.setattr(topk, "HELD", 9 * 4 * topk.HELD_BYTES)
    assert rows() == whole and sizes == [("q", 4), ("d", topk.DOC_BLOCK)]


def test_memory_of_a_worker_in_the_similarity_join():
    """As many queries as a block has, 2,048 documents held each, 40 blocks of documents: the traced memory is bounded and the result whole."""
    rng, k, tokens = np.random.default_rng(3), 2048, 4
    q, d = rng.normal(size=(topk.HELD // (k * topk.HELD_BYTES), 64)), rng.normal(size=(40 * topk.DOC_BLOCK, 64))
    tracemalloc.start()
    held = topk.Held(len(q), k)
    for at in range(0, len(d), topk.DOC_BLOCK):
        block = d[at : at + topk.DOC_BLOCK]
        for i, score in topk._scored(q, block, tokens):
            held.add(score, np.arange(at, at + len(block)), i)
    held.batch(np.arange(len(q)), ["a"] * len(q))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    row, doc, _ = held.best()
    some = topk._maxsims(q[:3], d, tokens)
    assert len(row) == len(q) * k and all(set(doc[row == i]) == set(np.argsort(-some[i])[:k]) for i in range(3))
    assert most < 64 << 20, most


@pytest.mark.parametrize("most", [10**9, 100])
def test_scores_of_pairs(spark, most):
    q, d = vectors(spark, 30, "query_id", 3), vectors(spark, 50, "document_id", 4)
    pairs = q.select("split", "query_id").join(d.select("split", "document_id"), "split").where("(query_id + document_id) % 3 > 0")
    none = spark.createDataFrame([("a", 99, 2), ("a", 2, 99), ("c", 2, 2)], "split string, query_id bigint, document_id bigint")
    got = topk.pair_scores(pairs.union(none), q, d, 2, "s", most)
    want = topk.rescored(pairs.join(q.withColumnRenamed("v", "qv"), ["split", "query_id"]).join(d.withColumnRenamed("v", "dv"), ["split", "document_id"]), "qv", "dv", 2, "s")
    rows = lambda df: sorted((r.split, r.query_id, r.document_id, round(r.s, 12)) for r in df.collect())
    assert rows(got) == rows(want)


def test_audit_from_the_negatives_of_a_query(spark):
    """The same report as from a row a pair and negative; the arms have a row a query and negative, however many positives."""
    rng = np.random.default_rng(5)
    ranks = lambda order: spark.createDataFrame([("ab"[q % 2], q, int(d), 1 - i / 50, i + 1) for q in range(6) for i, d in enumerate(order(q))], "split string, query_id bigint, document_id bigint, score double, rank int")
    mv, dense = ranks(lambda q: rng.permutation(20)), ranks(lambda q: rng.permutation(20))
    positives = spark.createDataFrame([("ab"[q % 2], q, 100 + p, p) for q in range(6) for p in range(7)], "split string, query_id bigint, document_id bigint, label_pos int")
    queries = spark.createDataFrame([("ab"[q % 2], q, "t") for q in range(5)], schema.QUERIES)
    arms, rows = mining.ablation_arms(mv, dense, positives, queries, 4).cache(), mining.ablation_pairs(mv, dense, positives, queries, 4)
    assert arms.count() == 5 * 8 and rows.count() == 7 * arms.count()
    score = lambda c: f"CASE WHEN {c} % 9 = 1 THEN NULL ELSE ({c} * 7 + query_id * 3) % 11 / 11 END"
    full = rows.selectExpr("*", f"{score('document_id')} AS score", f"{score('positive_id')} AS positive_score")
    by_query = audits.mining_audit_by_query(arms.selectExpr("*", f"{score('document_id')} AS score"), rows.select("split", "query_id", "positive_id").distinct().selectExpr("split", "query_id", f"{score('positive_id')} AS positive_score"), 4)
    assert sorted(by_query.collect()) == sorted(audits.mining_audit(full, 4).collect()) and by_query.count() == 2


def test_shards_go_in_passes(spark, monkeypatch):
    assert metrics._passes([(0, 5), (1, 5), (2, 9), (3, None), (5, 1)], 10) == [(0, 1), (2, 5)] and metrics._passes([(0, 50), (1, 50)], 10) == [(0, 0), (1, 1)]
    corpus, calls, plain = vectors(spark, 60, "document_id", 6), [], metrics.similarity_topk
    queries = corpus.where("document_id % 10 = 0").withColumnRenamed("document_id", "query_id")
    monkeypatch.setattr(metrics, "similarity_topk", lambda *a: calls.append(1) or plain(*a))
    rows = lambda *a, **k: sorted((r.split, r.query_id, r["rank"], r.document_id) for r in metrics.sharded_run(queries, corpus, 5, *a, **k).collect())
    whole = rows(10)
    assert len(calls) == 1 and rows(10, pass_bytes=10 * 64) == whole and len(calls) == 7


def test_files_of_pairs_are_compressed(spark, tmp_path):
    """A query's text stands in the file once for each of its positives."""
    text = "".join(map(chr, np.random.default_rng(7).integers(97, 122, 3000)))
    cand = spark.createDataFrame([("a", 0, 1, d, 1 - d / 100) for d in range(20)], schema.CANDIDATES)
    pos = spark.createDataFrame([("a", 1, 100 + p, p) for p in range(200)], "split string, query_id long, document_id long, label_pos int")
    meta = mining.write_pairs(cand, pos, spark.createDataFrame([("a", 1, text)], schema.QUERIES), f"{tmp_path}/pairs", ["a"], 2, 5)
    size = lambda at: sum(os.path.getsize(f"{at}/{n}") for n in os.listdir(at) if n.startswith("part-"))
    rows = readers.read_pairs(spark, f"{tmp_path}/pairs")
    assert meta["total_pairs"] == 200 and {r.query for r in rows.collect()} == {text} and size(f"{tmp_path}/pairs") < 200 * len(text) / 10
    sinks.write_ascii_jsonl(rows, f"{tmp_path}/ascii", compression="gzip")
    assert spark.read.text(f"{tmp_path}/ascii").count() == 200 and size(f"{tmp_path}/ascii") < 200 * len(text) / 10


def test_what_pairs_share_is_made_into_json_once(spark, tmp_path):
    """The lines are those of whole rows; the text of a query is escaped where the queries are, before the join with its pairs."""
    texts = {1: 'a "q"\n\\ é😀', 2: None, 3: "short of negatives"}
    cand = spark.createDataFrame([("a", 0, q, d, 1 - d / 100) for q in texts for d in range(4 if q == 3 else 20)], schema.CANDIDATES)
    pos = spark.createDataFrame([("a", q, 100 + p, p) for q in texts for p in range(9)], "split string, query_id long, document_id long, label_pos int")
    queries = spark.createDataFrame([("a", q, x) for q, x in texts.items()], schema.QUERIES)
    columns = ["query_id", "split", "query", "positive_id", "negative_ids"]
    whole, lists = mining.mined_pairs(cand, pos, queries, 2, 5).select(columns), mining.query_lists(cand, pos, queries, 2, 5)
    rows = lambda df: sorted(r[0] for r in df.collect())
    assert whole.count() == 18
    for fields, plain in ((sinks.json_fields, sinks.json_rows(whole, *columns)), (sinks.ascii_fields, sinks.ascii_json_rows(whole, *columns))):
        lines = mining.pair_lines(pos, lists, fields)
        assert rows(lines) == rows(plain)
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        above, join = plan.split("Join Inner", 1)
        assert "negative_ids#" not in above and "query#" not in above and "tail" in join
    mining.write_pairs(cand, pos, queries, f"{tmp_path}/pairs", ["a"], 2, 5)
    assert rows(spark.read.text(f"{tmp_path}/pairs")) == rows(sinks.json_rows(whole, *columns))
    assert all(".lz4" in n for n in os.listdir(f"{tmp_path}/pairs") if n.startswith("part-"))


def test_a_stage_has_only_the_files_that_it_reads(spark, sf, monkeypatch):
    """Lists come from texts and the judged pool: no search by the whole vector, no padded parts, no labels in files."""
    asked, search = [], fixtures.similarity_topk
    monkeypatch.setattr(fixtures, "similarity_topk", lambda *a, tokens=1, **b: asked.append(tokens) or search(*a, tokens=tokens, **b))
    monkeypatch.setattr(fixtures.npz, "write_padded", lambda *_, **__: asked.append("parts"))
    monkeypatch.setattr(fixtures, "write_split", lambda df, folder, split: asked.append(folder.rsplit("/", 1)[1]) or sinks.write_split(df, folder, split))
    catalog.queries()["stage_kd_mixture"](spark, sf)
    assert asked.count(fixtures.MINER[0]) == 1 and set(asked) == {fixtures.MINER[0], "queries", "documents"}


@pytest.mark.parametrize("most", [4, 3])
def test_judgements_stay_where_they_are_while_the_values_are_few(spark, most):
    judged = spark.createDataFrame([(str(i % 5), i) for i in range(20)], "query_id string, rel int")
    values = spark.createDataFrame([(str(i), 10 * i) for i in range(1, 5)], "query_id string, n int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = metrics.looked_up(judged, values, "query_id", most)
        assert sorted((r.query_id, r.rel, r.n) for r in out.collect()) == sorted((str(i % 5), i, 10 * (i % 5)) for i in range(20) if i % 5)
        assert ("hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()) == (most < 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_judgements_are_counted_where_they_stand(spark, sf):
    """The ideal gains are those of all judgements in order, without an exchange or sort of them; a run's judgements by label are those of the join."""
    rng = np.random.default_rng(11)
    rels = [("ab"[q % 2], str(q), str(d), int(rng.integers(1, 4))) for q in range(7) for d in range(int(rng.integers(1, 300)))]
    qrels = spark.createDataFrame(rels, "dataset string, query_id string, doc_id string, rel int")
    got = {r.query_id: r for r in metrics.ideal_gains(qrels).collect()}
    for q in range(7):
        best = sorted((r[3] for r in rels if r[1] == str(q)), reverse=True)
        gain = [sum(x / np.log2(i + 2) for i, x in enumerate(best[:n])) for n in (10, 100)]
        assert got[str(q)].n_rel == len(best) and np.allclose([got[str(q)].i10, got[str(q)].i100], gain)
    plan = metrics.ideal_gains(qrels)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert "partial_count" in below and "Sort" not in below and "Window" not in plan
    f = fixtures.Fixtures(spark, sf)
    run = metrics.without_self(f.run)
    rows = lambda df: sorted((r.dataset, r.query_id, r.doc_id, r["rank"], r.rel) for r in df.collect())
    assert rows(f.run_judgements(run)) == rows(run.join(f.qrels, ["dataset", "query_id", "doc_id"])) != []
    assert metrics.ir_metrics(run, f.qrels, f.run_judgements(run)).collect() == metrics.ir_metrics(run, f.qrels).collect()


def test_a_worker_holds_a_slice_of_the_part_that_it_writes(tmp_path):
    """Lists go over the borders of slices; the file is whole, and what is held does not grow with it."""

    def slices(n, width):
        rng = np.random.default_rng(13)
        for at in range(0, n, 1000):
            q = np.arange(at, at + 1000) // width
            yield pa.RecordBatch.from_arrays([pa.array(["a"] * 1000), pa.array(np.zeros(1000, np.int32)), pa.array(q), pa.array(np.arange(at, at + 1000)), pa.array(rng.normal(size=1000))], ["split", "shard", "query_id", "document_id", "score"])

    most = {}
    for n in (200_000, 2_000_000):
        tracemalloc.start()
        with open(tmp_path / f"{n}.npz", "wb") as out:
            for split, shard, rows in npz._parts(slices(n, 300)):
                npz.padded(rows, out)
        most[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        with np.load(tmp_path / f"{n}.npz") as z:
            there = z["ids"] >= 0
            assert z["qids"].tolist() == list(range(-(-n // 300))) and z["ids"][there].tolist() == list(range(n)) and z["scores"].dtype == np.float32
            assert there.sum(1).tolist() == [300] * (n // 300) + [n % 300] * (n % 300 > 0) and np.isneginf(z["scores"][~there]).all()
            assert np.array_equal(z["scores"][there], np.concatenate([b.column("score").to_numpy() for b in slices(n, 300)]).astype(np.float32))
    assert most[2_000_000] < 16 << 20, most
    empty = io.BytesIO()
    npz.padded([], empty)
    with np.load(io.BytesIO(empty.getvalue())) as z:
        assert z["qids"].shape == (0,) and z["ids"].shape == (0, 0)


def test_judgements_take_little_space(spark, tmp_path):
    """Ids that come again beyond what the format's own dictionary and a short window find."""
    ids = np.random.default_rng(17).integers(10**9, 10**10, 6_000)
    rels = spark.createDataFrame([(str(q), str(d)) for q in range(100) for d in ids], "`query-id` string, `corpus-id` string").coalesce(1)
    spark.conf.set("parquet.dictionary.page.size", "1024")
    try:
        size = {}
        for kind in ("snappy", "zstd"):
            sinks.write_split(rels, f"{tmp_path}/{kind}", "test", compression=kind)
            size[kind] = os.path.getsize(f"{tmp_path}/{kind}/test-00000.parquet")
    finally:
        spark.conf.unset("parquet.dictionary.page.size")
    assert size["zstd"] < size["snappy"] / 2
