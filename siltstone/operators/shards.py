"""Ways to cut a table into shards, by the place of a row in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.sinks import staged

NAMESPACE = 1_000_000_000


def numbered(df: DataFrame, *key, by: tuple[str, ...] = ("split",), place: str = "at") -> DataFrame:
    """0-based place in order of `key` within `by`, and the group's size `n`.

    No task holds a whole group: rows are dealt by ranges of (by, key) and written, counts of (range, group) are summed
    up, and a row's place is its place in the range after all rows of the group in earlier ranges. Equal keys fall into
    one range; columns that make the key unique belong at its end.
    """
    part = "__range"
    dealt = staged(df.repartitionByRange(*by, *key).withColumn(part, F.spark_partition_id()), "ranges")
    group = list(by)
    sizes = dealt.groupBy(*group, part).agg(F.count("*").alias("__c"))
    whole = W.partitionBy(*(by or [F.lit(0)]))
    sizes = sizes.select(
        *[F.col(c).alias(f"__{c}") for c in by],
        F.col(part).alias("__p"),
        F.coalesce(F.sum("__c").over(whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__c").over(whole).alias("n"),
    )
    same = F.col(part) == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = W.partitionBy(*by, part).orderBy(*key)
    out = dealt.drop(*[c for c in ("n", place) if c in dealt.columns]).withColumn("__i", F.row_number().over(inside)).join(sizes, same)
    return out.withColumn(place, (F.col("__before") + F.col("__i") - 1).cast("bigint")).drop(part, "__p", "__before", "__i", *[f"__{c}" for c in by])


def contiguous(df: DataFrame, key: str, shards, by=("split",)) -> DataFrame:
    """Runs of ceil(n / shards) rows; the last shards may be empty. shards: a number or a column."""
    s = F.lit(shards) if isinstance(shards, int) else shards
    return numbered(df, key, by=by).withColumn("shard", F.floor(F.col("at") / F.ceil(F.col("n") / s)).cast("int"))


def strided(df: DataFrame, key: str, shards: int, by=("split",)) -> DataFrame:
    return numbered(df, key, by=by).withColumn("shard", (F.col("at") % shards).cast("int"))


def proportional(df: DataFrame, key: str, shards: int, by=("split",)) -> DataFrame:
    """Rows floor(n s / shards) to floor(n (s + 1) / shards) are shard s."""
    return numbered(df, key, by=by).withColumn("shard", F.floor(((F.col("at") + 1) * shards - 1) / F.col("n")).cast("int"))


def bounded(df: DataFrame, key: str, most: int, by=("split",)) -> DataFrame:
    """As few contiguous shards as hold at most `most` rows each."""
    return contiguous(df, key, F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most))), by)


def namespaced(split_index, id_):
    """One id space for all splits."""
    return F.lit(NAMESPACE).cast("bigint") * split_index + id_
