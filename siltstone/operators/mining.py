"""From candidates to mined pairs, and the ablation that pairs two miners."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.labels import distinct_positives, excluded, one_each
from siltstone.operators.topk import QUERY, exactly, ranked
from siltstone.sources.sinks import json_fields, shared_line, with_shared_fields, write_lines, write_text


def mined_negatives(candidates: DataFrame, positives: DataFrame, skip: int = 5, top_k: int = 50) -> DataFrame:
    """split, query_id, document_id, neg_rank: without any positive, after the first `skip`, exactly `top_k`; shorter queries go whole."""
    free = excluded(candidates, positives).join(positives.select(*QUERY).distinct(), list(QUERY), "left_semi")
    return exactly(ranked(free, top_k, name="neg_rank", skip=skip), top_k).select("split", "query_id", "document_id", "neg_rank")


def query_lists(candidates: DataFrame, positives: DataFrame, queries: DataFrame, skip: int = 5, top_k: int = 50) -> DataFrame:
    """split, query_id, negative_ids, query: what all pairs of a query share. The negatives in order; a missing text is empty, of repeated ids the last wins (`one_each`)."""
    lists = mined_negatives(candidates, positives, skip, top_k).groupBy(*QUERY).agg(F.array_sort(F.collect_list(F.struct("neg_rank", "document_id"))).alias("x"))
    lists = lists.select(*QUERY, F.transform("x", lambda r: r["document_id"]).alias("negative_ids"))
    text = one_each(queries, list(QUERY), "query", last=True)
    return lists.join(text, list(QUERY), "left").withColumn("query", F.coalesce("query", F.lit("")))


def mined_pairs(candidates: DataFrame, positives: DataFrame, queries: DataFrame, skip: int = 5, top_k: int = 50) -> DataFrame:
    """A row for each query and positive with what `query_lists` has of the query."""
    pairs = distinct_positives(positives).select("split", "query_id", F.col("document_id").alias("positive_id"))
    return pairs.join(query_lists(candidates, positives, queries, skip, top_k), list(QUERY))


def pair_lines(positives: DataFrame, lists: DataFrame, fields=json_fields) -> DataFrame:
    """json: the pairs of `mined_pairs` as JSON lines, from positives and `query_lists`; what the pairs of a query share is made into JSON once, and they come one after the other."""
    shared = with_shared_fields(lists, list(QUERY), ["query_id", "split", "query"], ["negative_ids"], fields)
    pairs = distinct_positives(positives).select("split", "query_id", F.col("document_id").alias("positive_id")).join(shared, list(QUERY))
    return pairs.select(shared_line(pairs, "positive_id", fields=fields).alias("json"))


def pair_stats(candidates: DataFrame, positives: DataFrame, skip: int = 5, top_k: int = 50) -> DataFrame:
    """Per split: pairs written, queries, those of several positives, pairs dropped for want of negatives, queries without candidates."""
    n_pos = distinct_positives(positives).groupBy(*QUERY).agg(F.count("*").alias("n_pos"))
    kept = mined_negatives(candidates, positives, skip, top_k).select(*QUERY).distinct().withColumn("kept", F.lit(1))
    has = candidates.select(*QUERY).distinct().withColumn("has", F.lit(1))
    x = n_pos.join(has, list(QUERY), "left").join(kept, list(QUERY), "left")
    count = lambda cond, what: F.sum(F.when(cond, what).otherwise(F.lit(0))).cast("bigint")
    is_kept, there = F.col("kept").isNotNull(), F.col("has").isNotNull()
    return x.groupBy("split").agg(
        count(is_kept, F.col("n_pos")).alias("pairs_written"),
        count(is_kept, F.lit(1)).alias("queries"),
        count(is_kept & (F.col("n_pos") > 1), F.lit(1)).alias("multi_positive_queries"),
        count(there & ~is_kept, F.col("n_pos")).alias("pairs_dropped_short_of_k"),
        count(~there, F.lit(1)).alias("queries_without_candidates"),
    )


def write_pairs(candidates: DataFrame, positives: DataFrame, queries: DataFrame, path: str, splits: list[str], skip: int = 5, top_k: int = 50) -> dict:
    """Writes `mined_pairs` as JSON lines (lz4: a query's pairs repeat its text and negatives, which are made into JSON once, one after the other) to `path` and what `pair_stats` counts, with the totals, to {path}.meta.json; gives the latter.

    The counts are observed while the pairs are written, before those without negatives go, so they cost no pass of their own.
    A split of `splits` without positives is left out.
    """
    spark = candidates.sparkSession
    lists = query_lists(candidates, positives, queries, skip, top_k)
    shared = candidates.select(*QUERY).distinct().join(with_shared_fields(lists, list(QUERY), ["query_id", "split", "query"], ["negative_ids"]), list(QUERY), "left").withColumn("has", F.lit(True))
    x = distinct_positives(positives).select("split", "query_id", F.col("document_id").alias("positive_id"), "label_pos", F.count("*").over(W.partitionBy(*QUERY)).alias("n_pos"))
    x = x.join(shared, list(QUERY), "left")
    kept, has, first = F.col("tail").isNotNull(), F.coalesce("has", F.lit(False)), F.col("label_pos") == 1
    counts = {"pairs_written": kept, "queries": kept & first, "multi_positive_queries": kept & first & (F.col("n_pos") > 1), "pairs_dropped_short_of_k": has & ~kept, "queries_without_candidates": first & ~has, "positives": F.lit(True)}
    seen = Observation()
    metrics = [F.count(F.when((F.col("split") == s) & cond, 1)).alias(f"{i}:{name}") for i, s in enumerate(splits) for name, cond in counts.items()]
    rows = x.observe(seen, *metrics).where(kept)
    write_lines(rows.select(shared_line(rows, "positive_id")), path, "lz4")
    got = seen.get
    per_split = {s: {name: got[f"{i}:{name}"] for name in counts} for i, s in enumerate(splits)}
    per_split = {s: {n: c for n, c in v.items() if n != "positives"} for s, v in per_split.items() if v["positives"]}
    meta = {"out": path, "skip": skip, "top_k": top_k, "row_unit": "(query, positive) pair", "all_annotated_positives_excluded_from_negatives": True, "total_pairs": sum(v["pairs_written"] for v in per_split.values()), "per_split": per_split}
    write_text(spark, f"{path}.meta.json", json.dumps(meta, indent=2))
    return meta


def ablation_pairs(multi: DataFrame, dense: DataFrame, positives: DataFrame, queries: DataFrame, top_k: int = 50) -> DataFrame:
    """split, query_id, positive_id, source ('mv', 'dense'), neg_rank, document_id.

    multi, dense: merged candidates with `rank`. The cut to top_k comes before the positives go, and top_k must be left
    in both arms: a query with a positive in either cut is dropped whole. Queries need a text.
    """
    pairs = distinct_positives(positives).select("split", "query_id", F.col("document_id").alias("positive_id"))
    return pairs.join(ablation_arms(multi, dense, positives, queries, top_k), list(QUERY))


def ablation_arms(multi: DataFrame, dense: DataFrame, positives: DataFrame, queries: DataFrame, top_k: int = 50) -> DataFrame:
    """The negatives of `ablation_pairs`, which all pairs of a query share: split, query_id, source, neg_rank, document_id. A row a query and negative, whatever the number of its positives."""
    arms = None
    for name, arm in (("mv", multi), ("dense", dense)):
        x = exactly(excluded(arm.where(F.col("rank") <= top_k), positives), top_k).select(*QUERY, F.lit(name).alias("source"), F.col("rank").alias("neg_rank"), "document_id")
        arms = x if arms is None else arms.union(x)
    both = arms.groupBy(*QUERY).agg(F.count_distinct("source").alias("arms")).where("arms = 2").select(*QUERY)
    texts = queries.where("query is not null").select(*QUERY).distinct()
    return arms.join(both, list(QUERY), "left_semi").join(texts, list(QUERY), "left_semi")


def arm_lists(rows: DataFrame, by=("split", "query_id", "positive_id")) -> DataFrame:
    """The packed form: negative_ids, first one arm then the other, and negative_sources beside them; a row for each `by`."""
    x = F.array_sort(F.collect_list(F.struct((F.col("source") != "mv").alias("arm"), "neg_rank", "document_id", "source")))
    packed = rows.groupBy(*by).agg(x.alias("x"))
    return packed.select(*by, F.transform("x", lambda r: r["document_id"]).alias("negative_ids"), F.transform("x", lambda r: r["source"]).alias("negative_sources"))


def first_rows(df: DataFrame, n: int, by=("split",), order=("query_id", "positive_id")) -> DataFrame:
    """The first n rows of each group in the stated order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
