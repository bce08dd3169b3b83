"""List scorers, JSON lines in ASCII and printed lines of the audits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import audits, listwise
from siltstone.sources import sinks


def plain(query, docs):
    """The surrogate of `listwise.attention`, a document at a time."""
    out = []
    for i, d in enumerate(docs):
        w = [np.exp(np.dot(d, e) / np.sqrt(len(d))) for e in docs[: i + 1]]
        context = sum(x * np.dot(query, e) for x, e in zip(w, docs)) / sum(w)
        out.append((np.dot(query, d) + context) / 2)
    return out


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(4)
    return {i: rng.normal(size=6).tolist() for i in range(40)}, {i: rng.normal(size=6).tolist() for i in range(30)}


def frames(spark, cells, lists):
    docs, queries = cells
    q = spark.createDataFrame(list(queries.items()), "query_id bigint, cell array<double>")
    d = spark.createDataFrame(list(docs.items()), "document_id bigint, cell array<double>")
    return spark.createDataFrame(lists, "query_id bigint, document_ids array<bigint>"), q, d


def test_order_and_company_change_scores(spark, cells):
    docs, queries = cells
    lists = [(0, [1, 2, 3, 4]), (1, [4, 3, 2, 1]), (2, [1, 2, 3, 5, 6]), (3, [1, 2, 3]), (4, None), (5, []), (6, [7, 7, 7, 8]), (0, [4, 3, 2, 1]), (0, [1, 2, 3, 4])]
    got = listwise.list_scores(*frames(spark, cells, lists), listwise.attention, width=4, batch=3).collect()
    want = sorted((q, tuple(d[:4])) for q, d in lists if d and len(d) >= 4)
    assert sorted((r.query_id, tuple(r.document_ids)) for r in got) == want
    for r in got:
        assert np.allclose(r.scores, plain(queries[r.query_id], [docs[d] for d in r.document_ids]), atol=1e-5)
    forth, back = ({tuple(r.document_ids): dict(zip(r.document_ids, r.scores)) for r in got if r.query_id == 0}[k] for k in ((1, 2, 3, 4), (4, 3, 2, 1)))
    assert abs(forth[3] - back[3]) > 1e-3


@pytest.mark.parametrize("batch", [1, 2, 7, 500])
def test_full_batches_and_one_of_what_is_left(spark, cells, batch):
    rng = np.random.default_rng(5)
    lists = [(i % 30, rng.integers(0, 40, 3).tolist()) for i in range(200)]
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def kernel(q, d):
        assert 0 < len(q) <= batch and q.shape == (len(q), 6) and d.shape == (len(q), 3, 6)
        sizes.add(len(q))
        calls.add(1)
        return listwise.attention(q, d)

    whole = listwise.list_scores(*frames(spark, cells, lists), kernel, width=3, batch=batch)
    got = sorted((r.query_id, tuple(r.document_ids), tuple(np.round(r.scores, 4))) for r in whole.collect())
    distinct = len({(q, tuple(d)) for q, d in lists})
    assert len(got) == 200 and sizes.value == distinct
    assert calls.value <= distinct // batch + 8  # a task has one short batch at most
    docs, queries = cells
    for q, d, s in got:
        assert np.allclose(s, plain(queries[q], [docs[i] for i in d]), atol=1e-4)


def test_missing_cells_and_wrong_shapes_are_errors(spark, cells):
    from pyspark.errors import PySparkException

    run = lambda lists, kernel=listwise.attention: listwise.list_scores(*frames(spark, cells, lists), kernel, width=2).collect()
    for lists in ([(0, [1, 99])], [(77, [1, 2])], [(0, [1, None])]):
        with pytest.raises(PySparkException, match="of a list is missing"):
            run(lists)
    with pytest.raises(PySparkException, match="the kernel gave"):
        run([(0, [1, 2])], lambda q, d: np.zeros(3))
    assert run([(0, [1])]) == [] == run([])


def test_texts(spark):
    lists = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "a", "b"])], "query_id bigint, document_ids array<string>")
    queries = spark.createDataFrame([(1, "x y x z"), (2, "")], "query_id bigint, cell string")
    docs = spark.createDataFrame([("a", "y w"), ("b", "x y"), ("c", "é z x y")], "document_id string, cell string")
    got = listwise.list_scores(lists, queries, docs, listwise.newly_covered, width=3).collect()
    assert sorted((r.query_id, r.document_ids, r.scores) for r in got) == [(1, ["a", "b", "c"], [1, 1, 1]), (2, ["c", "a", "b"], [0, 0, 0])]


def test_ascii_json_is_that_of_python(spark, tmp_path):
    texts = ["", "plain ~", "café ü", "😀x𝄞", 'q"uo\\te', "\\u00e9", "\b\t\n\f\r\x00\x1f\x7f\x80", " �￿", "é\n\\😀\"", "á 👩‍👩‍👧\r\n", "$1 \\\\1 {0} %s", None, "x" * 50_000 + "é" * 50_000]
    rows = [(i, t, [i, -1], i % 2 == 0, [t, "ö"]) for i, t in enumerate(texts)] + [(-(2**63), "ends", None, None, [])]
    names = ["id", "té\"xt", "ids", "flag", "texts"]
    df = spark.createDataFrame(rows, "id bigint, `té\"xt` string, ids array<int>, flag boolean, texts array<string>").coalesce(1)
    path = f"{tmp_path}/ascii"
    assert sinks.write_ascii_jsonl(df, path) and not sinks.write_ascii_jsonl(df, path)
    got = sorted(line for p in (tmp_path / "ascii").glob("part-*") for line in p.read_bytes().split(b"\n") if line)
    assert got == sorted(json.dumps(dict(zip(names, r))).encode() for r in rows)
    less = [r.json for r in sinks.ascii_json_rows(df, skip_null=True).collect()]
    assert less == [json.dumps({n: v for n, v in zip(names, r) if v is not None}) for r in rows]
    back = spark.read.schema(df.schema).json(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(TypeError):
        sinks.ascii_json_rows(df.select(F.lit(0.5).alias("x")))


def test_printed_lines_are_those_of_python(spark):
    rng = np.random.default_rng(7)
    values = np.round(np.concatenate([rng.random(200), np.arange(0, 1, 0.0005)]), 4)
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select(audits.places(F.col("v") * 100, 1).alias("a"), audits.places(F.col("v"), 3).alias("b"), "v").collect()
    assert [(r.a, r.b) for r in got] == [(f"{100 * r.v:.1f}", f"{r.v:.3f}") for r in got]
    rows = [("scidocs", 12, 0.1235, 1.0, -0.0125, 0.25, 0.3), ("a-very-long-name", 3, 0.0, 0.5, 1.5, 12.0, 0.05)]
    names = ["n", "mv_false_negative_rate", "dense_false_negative_rate", "mv_mean_negative_score", "dense_mean_negative_score", "set_overlap"]
    report = spark.createDataFrame(rows, "split string, n bigint, " + ", ".join(f"{c} double" for c in names[1:]))
    mean = [sum(r[1] * r[i] for r in rows) / 15 for i in range(2, 7)]
    line = lambda s, n, a, b, c, d, e: f"{s:10s} {n:4d} | {100 * a:7.1f}% {100 * b:10.1f}% | {c:8.3f} {d:10.3f} | {100 * e:6.1f}%"
    want = [line(*r) for r in sorted(rows)] + ["-" * 74, line("WEIGHTED", 15, *mean)]
    assert [r.line for r in audits.mining_lines(report).orderBy("line_no").collect()] == want
    assert audits.mining_lines(report.limit(0)).count() == 0


def test_gate_lines_keep_holes(spark):
    report = spark.createDataFrame([("b", "s1", 3, 0.5, 0.25), ("a", "s1", 1, 0.1, 1.0), ("a", "s2", 2, 0.4, 0.0)], "dir string, split string, rows bigint, fn_rate double, pos_at_1 double")
    want = [
        "split     " + f"{'b':>24s}{'a':>24s}",
        "s1        " + "     50.0% fn  25.0%@1" + "     10.0% fn 100.0%@1",
        "s2        " + " " * 24 + "     40.0% fn   0.0%@1",
        f"WEIGHTED {'b':24s} fn=50.0%  pos@1=25.0%",
        f"WEIGHTED {'a':24s} fn=30.0%  pos@1=33.3%",
    ]
    assert [r.line for r in audits.gate_lines(report, ["b", "a"]).orderBy("line_no").collect()] == want
