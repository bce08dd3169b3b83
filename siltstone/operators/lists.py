"""Fixed-width candidate lists for distillation: gold first, then candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.shards import namespaced
from siltstone.operators.topk import QUERY


def candidate_lists(pool: DataFrame, split_index: DataFrame, width: int = 32, cap: int = 0) -> DataFrame:
    """judged pool -> split, query_id, document_id (both in one id space), pos (1 .. width), section; lists short of `width` go whole.

    Golds in stored order, then candidates by judge score; rows without a finite score go, and there is no veto. cap: at most so many queries of a split.
    """
    s = F.col("judge_score")
    finite = F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))), s).otherwise(F.lit(float("-inf")))
    x = pool.withColumn("s", F.round(finite, 9)).where("s > double('-infinity')")
    x = x.withColumn("seen", F.row_number().over(W.partitionBy(*QUERY, "document_id").orderBy(F.col("section").desc(), "rank"))).where("seen = 1")
    order = [F.col("section").desc(), F.when(F.col("section") == "gold", F.col("rank")), F.col("s").desc(), F.col("document_id")]
    x = x.withColumn("pos", F.row_number().over(W.partitionBy(*QUERY).orderBy(*order))).where(F.col("pos") <= width)
    full = x.groupBy(*QUERY).agg(F.count("*").alias("n")).where(F.col("n") == width).select(*QUERY)
    if cap:
        full = full.withColumn("r", F.row_number().over(W.partitionBy("split").orderBy("query_id"))).where(F.col("r") <= cap).drop("r")
    x = x.join(full, list(QUERY), "left_semi").join(split_index, "split")
    return x.select("split", namespaced(F.col("split_index"), F.col("query_id")).alias("query_id"), namespaced(F.col("split_index"), F.col("document_id")).alias("document_id"), "pos", "section")


def packed(lists: DataFrame) -> DataFrame:
    """query_id, document_ids, scores: zero placeholders as long as the list."""
    x = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "document_id"))).alias("x"))
    return x.select("query_id", F.transform("x", lambda r: r["document_id"]).alias("document_ids"), F.array_repeat(F.lit(0.0).cast("float"), F.size("x")).alias("scores"))


def fixed_width(packed_lists: DataFrame, width: int) -> DataFrame:
    """The first `width` of each list; shorter ones go."""
    return packed_lists.withColumn("document_ids", F.slice("document_ids", 1, width)).where(F.size("document_ids") == width)


def used_documents(lists: DataFrame) -> DataFrame:
    """split, document_id of all lists, once each."""
    return lists.select("split", "document_id").distinct()


def list_stats(pool: DataFrame, lists: DataFrame) -> DataFrame:
    """split, rows, dropped_short, documents."""
    n_all = pool.groupBy("split").agg(F.count_distinct("query_id").alias("all"))
    n = lists.groupBy("split").agg(F.count_distinct("query_id").alias("rows"), F.count_distinct("document_id").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    x = n_all.join(n, "split", "left")
    return x.select("split", zero(F.col("rows")).alias("rows"), (F.col("all") - zero(F.col("rows"))).alias("dropped_short"), zero(F.col("documents")).alias("documents"))


def swapped_teacher(packed_lists: DataFrame, teacher: DataFrame) -> DataFrame:
    """Lists that have teacher scores, with those; of repeated teacher rows the last shard wins."""
    last = teacher.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("shard").desc()))).where("r = 1").select("query_id", "scores")
    return packed_lists.drop("scores").join(last, "query_id")
