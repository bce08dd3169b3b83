"""Stages that run shard by shard and can be begun again: a table by (split, shard) and a manifest of what is finished.

A shard is written by overwriting its own partition, then noted in the manifest beside the table ({path}-done: split,
shard, rows). What stops between the two leaves a shard that is not noted; it is computed again and replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.readers import listed

_DONE = "split string, shard int, rows bigint, noted bigint"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """split, shard, rows of the finished shards of a table; of a shard noted several times the last note holds."""
    folder = f"{path}-done"
    if not listed(spark, folder):
        return spark.createDataFrame([], "split string, shard int, rows bigint")
    rows = spark.read.schema(_DONE).json(folder)
    return rows.groupBy("split", "shard").agg(F.max_by("rows", "noted").alias("rows"))


def note(spark: SparkSession, path: str, rows: list[tuple[str, int, int]]) -> None:
    spark.createDataFrame([(*r, time.time_ns()) for r in rows], _DONE).coalesce(1).write.mode("append").json(f"{path}-done")


def _remove(spark: SparkSession, path: str, split: str, shard: int) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name('split', split)}/{name('shard', str(shard))}")
    target.getFileSystem(conf).delete(target, True)


def overwrite_parts(df: DataFrame, path: str) -> None:
    """Replaces the partitions (split, shard) that `df` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "shard").parquet(path)


def run_parts(spark: SparkSession, path: str, parts: Iterable[tuple[str, int]], compute: Callable[[str, int], DataFrame], *, again: bool = False) -> list[tuple[str, int]]:
    """Computes and writes the shards that are not finished, one after the other; gives those computed.

    compute(split, shard) gives the shard's rows; they are counted while they are written. A shard without rows is finished, too.
    """
    there = set() if again else {(r.split, r.shard) for r in finished(spark, path).collect()}
    computed = []
    for split, shard in parts:
        if (split, shard) in there:
            continue
        count = Observation()
        rows = compute(split, shard).withColumn("split", F.lit(split)).withColumn("shard", F.lit(shard))
        overwrite_parts(rows.observe(count, F.count(F.lit(1)).alias("rows")), path)
        n = count.get["rows"]
        if not n:
            _remove(spark, path, split, shard)
        note(spark, path, [(split, shard, n)])
        computed.append((split, shard))
    return computed


def write_parts(df: DataFrame, path: str, again: bool = False) -> list[tuple[str, int]]:
    """Candidates or judge scores by (split, shard): writes the parts of `df` that are not finished (with `again`, all of them); gives the parts that were not finished before.

    The manifest's row counts are read from the files' footers, not from `df` a second time.
    """
    spark = df.sparkSession
    before = {(r.split, r.shard) for r in finished(spark, path).collect()}
    if before and not again:  # a row a part
        df = df.join(spark.createDataFrame(sorted(before), "split string, shard int"), ["split", "shard"], "left_anti")
    overwrite_parts(df, path)
    if not any(n.startswith("split=") for n in listed(spark, path)):
        return []
    table = spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split"), F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("rows"))
    counts = [tuple(r) for r in table.orderBy("split", "shard").collect()]
    new = [c[:2] for c in counts if c[:2] not in before]
    if new or again:
        note(spark, path, counts if again else [c for c in counts if c[:2] in new])
    return new
