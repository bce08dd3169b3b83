"""Padded parts through the data source, and stages that are begun again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.sources import npz, readers, restart


def rows_of(df):
    return sorted((r.split, r.shard, r.query_id, r.document_id, r.score) for r in df.collect())


def some(spark, parts, n=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, p, q, int(d), float(np.float32(rng.normal()))) for s, p in parts for q in range(1, 6) for d in rng.choice(1000, rng.integers(1, n), replace=False)]
    return spark.createDataFrame(rows, schema.CANDIDATES).repartition(5)


def test_round_trip(spark, tmp_path):
    path = f"file:{tmp_path}/parts"
    df = some(spark, [("a", 0), ("a", 1), ("b", 12)])
    assert npz.write_padded(df, path) == [("a", 0), ("a", 1), ("b", 12)]
    assert rows_of(npz.read_padded(spark, path)) == rows_of(df) == rows_of(readers.read_npz(spark, path).select(*df.columns))
    with np.load(tmp_path / "parts" / "b_012.npz") as part:
        assert part["ids"].shape == part["scores"].shape and part["scores"].dtype == np.float32 and (np.diff(part["qids"]) > 0).all()
        padding = part["ids"] < 0
        assert np.isneginf(part["scores"][padding]).all() and all((np.diff(s[i >= 0]) <= 0).all() for s, i in zip(part["scores"], part["ids"]))
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["a_000.npz", "a_001.npz", "b_012.npz"]


def test_filters_choose_parts(spark, tmp_path):
    """A part that no filter lets in is not opened: it may be no .npz at all."""
    path = str(tmp_path)
    df = some(spark, [("a", 0), ("a", 1), ("b", 0)])
    npz.write_padded(df, path)
    (tmp_path / "b_000.npz").write_bytes(b"no zip")
    assert rows_of(npz.read_padded(spark, path, "a")) == rows_of(df.where("split = 'a'"))
    one = npz.read_padded(spark, path, "a", 1)
    assert one.rdd.getNumPartitions() == 1 and rows_of(one.where("query_id > 2")) == rows_of(df.where("split = 'a' and shard = 1 and query_id > 2"))
    assert rows_of(npz.read_padded(spark, path).where(F.col("shard").isin(1, 7))) == rows_of(df.where("shard = 1"))
    assert npz.read_padded(spark, path, "z").count() == 0 and npz.read_padded(spark, f"{path}/nothing").count() == 0


def test_slices_and_older_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(npz, "SLICE", 7)
    part = {"qids": np.arange(50), "ids": np.where(np.arange(150).reshape(50, 3) % 4 == 0, -1, np.arange(150).reshape(50, 3)), "scores": np.where(np.arange(150).reshape(50, 3) % 5 == 0, np.nan, 1.0)}
    np.savez(tmp_path / "old.npz", **part)
    np.savez(tmp_path / "new_3.npz", **part)
    np.savez(tmp_path / "new.npz", **part)  # passed over: the split has parts of its own
    reader = npz.PartsReader(str(tmp_path))
    assert [(p.split, p.shard) for p in reader.partitions()] == [("new", 3), ("old", 0)]
    batches = list(reader.read(reader.partitions()[1]))
    assert len(batches) == 25 and sum(b.num_rows for b in batches) == sum(i % 4 != 0 and i % 5 != 0 for i in range(150))


def test_parts_that_stand_stay(spark, tmp_path):
    path = str(tmp_path)
    first, more = some(spark, [("a", 0)]), some(spark, [("a", 0), ("a", 1)], seed=2)
    npz.write_padded(first, path)
    assert npz.write_padded(more, path) == [("a", 1)]
    assert rows_of(npz.read_padded(spark, path)) == rows_of(first.union(more.where("shard = 1")))
    assert npz.write_padded(more.where("shard = 0"), path, again=True) == [("a", 0)]
    assert rows_of(npz.read_padded(spark, path)) == rows_of(more)
    with pytest.raises(Exception, match="there already"):
        more.repartition(1).sortWithinPartitions("split", "shard", "query_id").write.format(npz.FORMAT).mode("append").save(path)


def test_failures_leave_nothing(spark, tmp_path):
    path = str(tmp_path)
    df = some(spark, [("a", 0), ("a", 1), ("b", 0), ("b", 1)])
    broken = df.repartition("split", "shard").sortWithinPartitions("split", "shard", "query_id")
    bad = F.when((F.col("split") == "b") & (F.col("shard") == 1) & (F.col("query_id") == 5), F.raise_error(F.lit("lost"))).otherwise(F.col("score"))
    with pytest.raises(Exception, match="lost"):
        broken.withColumn("score", bad).write.format(npz.FORMAT).mode("append").save(path)
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="several tasks"):
        df.where("split = 'a' and shard = 0").repartition(3).sortWithinPartitions("query_id").write.format(npz.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="come together"):
        df.coalesce(1).sortWithinPartitions("query_id", "split", "shard").write.format(npz.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="over the width"):
        npz.write_padded(df, path, width=2)
    assert list(tmp_path.iterdir()) == []
    assert len(npz.write_padded(df, path, width=30)) == 4


def test_shards_written_one_after_the_other_all_stand(spark, tmp_path):
    path = f"{tmp_path}/parts"
    df = some(spark, [("a", 0), ("a", 1), ("b", 0)])
    for shard in (0, 1):
        assert restart.write_parts(df.where(F.col("shard") == shard), path)
    assert rows_of(readers.read_parts(spark, path).select(*df.columns)) == rows_of(df)
    other = some(spark, [("a", 1)], seed=3)
    assert restart.write_parts(other, path) == [] and rows_of(readers.read_parts(spark, path).select(*df.columns)) == rows_of(df)
    assert restart.write_parts(other, path, again=True) == []
    assert rows_of(readers.read_parts(spark, path).select(*df.columns)) == rows_of(df.where("split = 'b' or shard = 0").union(other))
    assert {(r.split, r.shard): r["rows"] for r in restart.finished(spark, path).collect()}["a", 1] == other.count()


def test_a_run_that_stopped_computes_the_rest_only(spark, tmp_path):
    path = f"{tmp_path}/run"
    df = some(spark, [("a", 0), ("a", 1), ("b", 0)])
    parts, asked = [("a", 0), ("a", 1), ("a", 2), ("b", 0)], []

    def compute(split, shard, stop=None):
        asked.append((split, shard))
        if (split, shard) == stop:
            raise RuntimeError("stopped")
        return df.where((F.col("split") == split) & (F.col("shard") == shard)).drop("split", "shard")

    with pytest.raises(RuntimeError, match="stopped"):
        restart.run_parts(spark, path, parts, lambda s, n: compute(s, n, ("a", 2)))
    asked.clear()
    assert restart.run_parts(spark, path, parts, compute) == [("a", 2), ("b", 0)] == asked
    assert rows_of(readers.read_parts(spark, path).select(*df.columns)) == rows_of(df)
    assert {(r.split, r.shard): r["rows"] for r in restart.finished(spark, path).collect()}["a", 2] == 0
    assert restart.run_parts(spark, path, parts, compute) == []
    # A shard that was written, but not noted, is replaced and not doubled; one that is empty when computed anew is removed.
    restart.overwrite_parts(df.where("split = 'b'"), path)
    assert restart.run_parts(spark, path, [("a", 1)], lambda s, n: df.where("false").drop("split", "shard"), again=True) == [("a", 1)]
    assert rows_of(readers.read_parts(spark, path).select(*df.columns)) == rows_of(df.where("not (split = 'a' and shard = 1)"))
