"""Memory of the driver and of the Python workers: bounded by batches and by the sample, whatever the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import common, contamination, quality

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_bounded(spark):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "64m")
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcde fghi"), F.lit(500)).alias("text"))
        quality.scored(docs, quality.Model())
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
        assert len(sizes) > 3 and max(r.n for r in sizes) < 2 * common.BATCH_BYTES  # 15 MB in one batch before
        spark.conf.set(KEY, "1m")
        common.bounded_batches(spark)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before)


def test_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(1, "some words", "x"), (2, None, "y")], "doc_id long, TEXT string, source string")
    items = spark.createDataFrame([("a", "one two three four five six seven")], "item_id string, text string")
    for out in (quality.scored(docs, quality.Model()), contamination.decontaminated(docs, items)):
        assert "__text" not in plan(out) and out.columns[:3] == docs.columns
        assert sorted((r.doc_id, r.TEXT) for r in out.collect()) == [(1, "some words"), (2, None)]


def test_training_holds_two_matrices(spark):
    texts = [b"\n".join(b"Line %d of text %d." % (i, j) * (1 + i % 3) for i in range(40)) for j in range(200)]
    x, weight, sizes = quality.line_features(texts)
    label = np.arange(200) % 2
    quality.Model(x, weight, sizes, label, rounds=(1,))
    tracemalloc.start()
    quality.Model(x, weight, sizes, label, rounds=(1,))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes  # beside x; three of its size before


def test_repeated_ids_train_as_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Model", lambda *a: seen.append(a))
    texts = {(1, "One.\nTwo words.\n\nLast line here"), (1, "Another text.\nof two lines"), (2, "x"), (3, "")}
    docs = spark.createDataFrame(sorted(texts) + [(4, None)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int"))
    x, weight, sizes, label = seen[0]
    want = {(int(d != 2), w.tobytes(), f.astype(np.float32).tobytes()) for d, t in texts for f, w, _ in [quality.line_features([t.encode()])]} | {(0, *(y.tobytes() for y in (quality.line_features([b""])[1], quality.line_features([b""])[0].astype(np.float32))))}
    at = np.concatenate(([0], np.cumsum(sizes)))
    got = {(int(y), weight[i:j].astype(np.int64).tobytes(), x[i:j].astype(np.float32).tobytes()) for y, i, j in zip(label, at, at[1:])}
    assert got == want and sorted(sizes) == [1, 1, 1, 2, 4]  # the two texts of id 1 were cut into one another before
