"""Order of rows in files, statistics counted while writing, evaluation by shards, draws by runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.operators import audits, labels, metrics, mining, mixture, topk
from siltstone.sources import readers, sinks


def test_first_and_last_rows_of_files(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, "document_id long, document string").coalesce(1)
    assert sinks.write_split(frame([(1, "z"), (2, None), (1, "a"), (3, "m")]), f"{root}/documents", "fiqa") == 1
    assert sinks.write_split(frame([(2, "late"), (4, "new"), (1, "b")]), f"{root}/documents", "fiqa", 1) == 1
    assert readers.listed(spark, f"{root}/documents") == ["fiqa-00000.parquet", "fiqa-00001.parquet"]
    docs = readers.scan_split(spark, root, "documents", "fiqa", ordered=True)
    asked = spark.createDataFrame([("fiqa", i) for i in (1, 2, 3, 4, 5)], "split string, document_id long")
    assert sorted((r.document_id, r.document) for r in labels.looked_up(asked, docs).collect()) == [(1, "z"), (2, None), (3, "m"), (4, "new"), (5, None)]
    last = labels.one_each(docs, ["document_id"], "document", last=True)
    assert sorted((r.document_id, r.document) for r in last.collect()) == [(1, "b"), (2, "late"), (3, "m"), (4, "new")]
    assert sorted((r.file, r.row) for r in docs.where("document_id = 1").collect()) == [("fiqa-00000.parquet", 0), ("fiqa-00000.parquet", 2), ("fiqa-00001.parquet", 2)]
    assert [r.document_id for r in mining.first_rows(docs, 5, order=readers.FILE_ORDER).orderBy("file", "row").collect()] == [1, 2, 1, 3, 2]


def test_many_files_of_one_split(spark, tmp_path):
    df = spark.range(0, 1000, 1, 5).withColumnRenamed("id", "document_id")
    assert sinks.write_split(df, f"{tmp_path}/documents", "a") == 5
    rows = readers.scan_split(spark, str(tmp_path), "documents", "a", ordered=True).orderBy("file", "row").collect()
    assert [r.document_id for r in rows] == list(range(1000)) and {r.file for r in rows} == {f"a-0000{i}.parquet" for i in range(5)}


def test_pairs_and_their_counts(spark, tmp_path):
    cand = spark.createDataFrame([("a", 0, q, d, 1 - d / 100) for q in (1, 2, 3) for d in range(20 if q < 3 else 4)] + [("b", 0, 9, d, 1 - d / 100) for d in range(20)], schema.CANDIDATES)
    pos = spark.createDataFrame([("a", 1, 0, 1), ("a", 1, 50, 2), ("a", 1, 0, 3), ("a", 2, 3, 1), ("a", 3, 3, 1), ("a", 4, 7, 1), ("b", 9, 1, 1)], "split string, query_id long, document_id long, label_pos int")
    queries = spark.createDataFrame([("a", 1, "é"), ("b", 9, "q")], schema.QUERIES)
    path = f"{tmp_path}/pairs"
    meta = mining.write_pairs(cand, pos, queries, path, ["a", "b", "c"], 2, 5)
    assert json.loads((tmp_path / "pairs.meta.json").read_text()) == meta and meta["total_pairs"] == 4
    want = {r.split: {c: r[c] for c in r.__fields__ if c != "split"} for r in mining.pair_stats(cand, pos, 2, 5).collect()}
    assert meta["per_split"] == want and set(want) == {"a", "b"}
    got = readers.read_pairs(spark, path)
    assert sorted(got.collect()) == sorted(mining.mined_pairs(cand, pos, queries, 2, 5).select(*got.columns).collect())


@pytest.mark.parametrize("tokens", [1, 2])
def test_evaluation_by_shards_is_that_of_the_whole(spark, tokens):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 8)).round(1)
    corpus = spark.createDataFrame([("ab"[i % 2], i, v.tolist()) for i, v in enumerate(x)], "split string, document_id bigint, v array<double>")
    queries = corpus.where("document_id % 10 = 0").withColumnRenamed("document_id", "query_id")
    rows = lambda most: sorted((r.split, r.query_id, r["rank"], r.document_id, round(r.score, 9)) for r in metrics.sharded_run(queries, corpus, 20, most, tokens).collect())
    whole = rows(1000)
    assert rows(100) == whole == rows(37) and len(whole) == 15 * 20 and all(q != d for _, q, _, d, _ in whole)
    plain = topk.ranked(topk.similarity_topk(queries, corpus, 150, tokens, within_split=False).where("query_id <> document_id"), 20)
    assert whole == sorted((r.split, r.query_id, r["rank"], r.document_id, round(r.score, 9)) for r in plain.collect())


def test_numbers_unfold_in_runs(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 0), ("c", -3), (None, 7)], "split string, n long")
    got = mixture.numbers(rows, F.col("n"), "i", run=3)
    assert sorted((r.split or "", r.i) for r in got.collect()) == sorted([("a", i) for i in range(1, 11)] + [("", i) for i in range(1, 8)])
    many = mixture.numbers(spark.createDataFrame([("a", 10**8)], "split string, n long"), F.col("n"), "i")
    assert many.agg(F.count("*"), F.sum("i"), F.max("i")).first() == (10**8, 10**8 * (10**8 + 1) // 2, 10**8)


def test_pivot_keeps_holes(spark):
    report = spark.createDataFrame([("x", "s1", 0.1, 0.9), ("y", "s1", 0.2, 0.8), ("y", "s2", 0.3, 0.7), ("z", "s3", 1.0, 1.0)], "dir string, split string, fn double, p double")
    two = audits.pivoted(report, "dir", ["y", "x"], ["fn", "p"])
    assert two.columns == ["split", "y_fn", "y_p", "x_fn", "x_p"]
    assert sorted(tuple(r) for r in two.collect()) == [("s1", 0.2, 0.8, 0.1, 0.9), ("s2", 0.3, 0.7, None, None), ("s3", None, None, None, None)]
    one = audits.pivoted(report, "dir", ["x", "y"], ["fn"])
    assert sorted(tuple(r) for r in one.collect()) == [("s1", 0.1, 0.2), ("s2", None, 0.3), ("s3", None, None)]
