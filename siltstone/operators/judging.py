"""The judged pool, the false-negative veto and the score band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import filled
from siltstone.operators.labels import capped_gold, excluded
from siltstone.operators.topk import QUERY, best_first, ranked, valid

PAIR = ("split", "query_id", "positive_id")


def eligible(candidates: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with candidates, a label and a text."""
    keys = list(QUERY)
    return candidates.select(*keys).distinct().join(labels.select(*keys), keys, "left_semi").join(queries.where("query is not null").select(*keys), keys, "left_semi")


def candidates_to_judge(candidates: DataFrame, labels: DataFrame, documents: DataFrame, top_n: int = 256, cap: int = 12) -> DataFrame:
    """split, query_id, document_id, rank: without the first `cap` golds, cut to top_n, then only documents with text (so a list may be shorter)."""
    cut = ranked(excluded(candidates, capped_gold(labels, cap)), top_n)
    texts = documents.where(filled(F.col("document"))).select("split", "document_id").distinct()
    return cut.join(texts, ["split", "document_id"], "left_semi").select("split", "query_id", "document_id", "rank")


def gold_to_judge(labels: DataFrame, documents: DataFrame, cap: int = 12) -> DataFrame:
    """split, query_id, document_id, rank: each of the first `cap` golds once, with text."""
    once = capped_gold(labels, cap).groupBy("split", "query_id", "document_id").agg(F.min("gold_pos").alias("rank"))
    texts = documents.where(filled(F.col("document"))).select("split", "document_id").distinct()
    return once.join(texts, ["split", "document_id"], "left_semi").select("split", "query_id", "document_id", "rank")


def judged_pool(queries_eligible: DataFrame, gold: DataFrame, cand: DataFrame, score, least: int = 5) -> DataFrame:
    """split, query_id, section ('gold', 'cand'), document_id, rank, judge_score, for queries with a gold and `least` candidates.

    score: takes rows with split, query_id, document_id and adds `judge_score` (the Scorer).
    """
    keys = list(QUERY)
    both = gold.withColumn("section", F.lit("gold")).unionByName(cand.withColumn("section", F.lit("cand"))).join(queries_eligible, keys, "left_semi")
    n = lambda s: F.sum((F.col("section") == s).cast("int"))
    enough = both.groupBy(*keys).agg(n("gold").alias("g"), n("cand").alias("c")).where(f"g >= 1 and c >= {least}").select(*keys)
    return score(both.join(enough, keys, "left_semi"))


def latest(parts: DataFrame) -> DataFrame:
    """Of a query's rows those of the last shard that has it."""
    return parts.withColumn("__s", F.max("shard").over(W.partitionBy(*QUERY))).where("shard = __s").drop("__s")


def pair_candidates(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """split, query_id, positive_id, positive_score, document_id, score: for each pair whose positive was judged, the valid candidates that are no gold."""
    sound = valid(pool.withColumnRenamed("judge_score", "score"))
    gold = sound.where("section = 'gold'").groupBy("split", "query_id", F.col("document_id").alias("positive_id")).agg(F.first("score").alias("positive_score"))
    cand = sound.where("section = 'cand'").select("split", "query_id", "document_id", "score")
    cand = cand.join(pool.where("section = 'gold'").select("split", "query_id", "document_id"), ["split", "query_id", "document_id"], "left_anti")
    return pairs.select(*PAIR).join(gold, list(PAIR)).join(cand, list(QUERY))


def veto_risk(judged: DataFrame, splits: DataFrame) -> DataFrame:
    """split, judged_pairs, candidates, vetoed, risk: counted for each pair, also those that are dropped later; all splits appear."""
    per = judged.groupBy(*PAIR).agg(F.count("*").alias("c"), F.sum((F.col("score") >= F.col("positive_score")).cast("int")).alias("v"))
    got = per.groupBy("split").agg(F.count("*").alias("judged_pairs"), F.sum("c").alias("candidates"), F.sum("v").alias("vetoed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = splits.select("split").distinct().join(got, "split", "left").select("split", *[zero(c).alias(c) for c in ("judged_pairs", "candidates", "vetoed")])
    return out.withColumn("risk", F.col("vetoed") / F.greatest("candidates", F.lit(1)))


def band_pool(judged: DataFrame, negatives: int = 7, band: float = 0.97, unfiltered: bool = False) -> DataFrame:
    """split, query_id, positive_id, positive_score, document_id, ratio, pool_rank, survivors: the negatives a pair may draw from.

    Survivors score under the positive; by ratio to it downwards, those at `band` or over, and at least the best `negatives`.
    Pairs with fewer survivors go. unfiltered: all candidates by score.
    """
    pair = W.partitionBy(*PAIR)
    x = judged.withColumn("ratio", F.col("score") / F.greatest("positive_score", F.lit(1e-9)))
    if not unfiltered:
        x = x.where(F.col("score") < F.col("positive_score"))
    x = x.withColumn("survivors", F.count("*").over(pair)).where(F.col("survivors") >= negatives)
    order = best_first("score") if unfiltered else best_first("ratio")
    if not unfiltered:
        x = x.withColumn("early", F.sum((F.col("ratio") >= 1).cast("int")).over(pair)).where(F.col("ratio") < 1).where(F.col("survivors") - F.col("early") >= negatives)
        x = x.withColumn("in_band", F.sum((F.col("ratio") >= band).cast("int")).over(pair))
    x = x.withColumn("pool_rank", F.row_number().over(pair.orderBy(*order)))
    if not unfiltered:
        x = x.where(F.col("pool_rank") <= F.greatest("in_band", F.lit(negatives)))
    return x.select(*PAIR, "positive_score", "document_id", "ratio", "pool_rank", "survivors")


def usable_pairs(pool: DataFrame) -> DataFrame:
    return pool.groupBy(*PAIR).agg(F.max("positive_score").alias("positive_score"), F.max("survivors").alias("survivors"), F.count("*").alias("pool_size"))
