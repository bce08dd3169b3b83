"""Apportionment by usable rows and risk, reproducible sampling, training rows, and the third-party triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.draws import integer, order_key
from siltstone.operators.judging import PAIR
from siltstone.operators.shards import numbered

#: Fixed values of the published calibration: usable pairs, risk and target of the source it is scaled from.
CALIBRATION = (3672, 0.2075, 31979)


def targets(usable: DataFrame, risk: DataFrame, budget: int) -> DataFrame:
    """split, usable_pairs, risk, weight, exact, target: weight sqrt(pairs) (1 - risk), largest remainders, ties in order of split; the targets sum to the budget.

    A row a split; the only windows over all rows are over splits. Without any weight this is an error.
    """
    n = usable.groupBy("split").agg(F.count("*").alias("usable_pairs"))
    every = W.partitionBy(F.lit(0))
    x = risk.select("split", "risk").join(n, "split", "left").withColumn("usable_pairs", F.coalesce("usable_pairs", F.lit(0)).cast("bigint"))
    x = x.withColumn("weight", F.sqrt("usable_pairs") * (F.lit(1.0).cast("double") - F.col("risk")))
    total = F.sum(F.round("weight", 12)).over(every)
    x = x.withColumn("exact", F.when(total > 0, F.lit(budget) * F.col("weight") / total).otherwise(F.raise_error(F.lit("no usable rows remain"))))
    x = x.withColumn("low", F.floor("exact")).withColumn("left", F.lit(budget) - F.sum("low").over(every))
    place = F.row_number().over(every.orderBy(F.round(F.col("exact") - F.col("low"), 9).desc(), "split"))
    return x.withColumn("target", (F.col("low") + (place <= F.col("left")).cast("int")).cast("bigint")).select("split", "usable_pairs", "risk", "weight", "exact", "target")


#: Numbers that one row is unfolded into at once.
RUN = 1 << 16


def numbers(rows: DataFrame, n: Column, name: str, run: int = RUN) -> DataFrame:
    """Each row once for each of the numbers 1 .. n, as `name`: first dealt out by runs of numbers, then unfolded, so neither an array nor a task holds them all."""
    runs = rows.withColumn("__n", n.cast("bigint")).where("__n > 0").withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {run}"))))
    first = F.col("__run") * run + 1
    return runs.repartition(*rows.columns, "__run").withColumn(name, F.explode(F.sequence(first, F.least(F.col("__n"), first + (run - 1))))).drop("__n", "__run")


def sampled(usable: DataFrame, goal: DataFrame, seed: int = 42) -> DataFrame:
    """split, query_id, positive_id, copy_no: as many rows as the split's target.

    Target within the rows: a draw without replacement (copy 0). Over it: every row once, and the rest drawn with
    replacement (copies numbered by draw).
    """
    rows = numbered(usable.select(*PAIR), "query_id", "positive_id").drop("n")
    rows = numbered(rows.withColumn("key", order_key(seed, *PAIR)), "key", "query_id", "positive_id", place="drawn").drop("n", "key").withColumn("drawn", F.col("drawn") + 1)
    sizes = rows.groupBy("split").agg(F.count("*").alias("n"))
    goals = goal.select("split", "target").join(sizes, "split")
    base = rows.join(goals, "split").where("drawn <= target").select(*PAIR, F.lit(0).cast("bigint").alias("copy_no"))
    draws = numbers(goals.where("target > n"), F.col("target") - F.col("n"), "copy_no").select("split", "n", "copy_no")
    draws = draws.withColumn("at", F.pmod(integer(seed, "split", F.lit("draw"), "copy_no"), F.col("n")))
    return base.union(draws.join(rows.select(*PAIR, "at"), ["split", "at"]).select(*PAIR, "copy_no"))


def training_rows(rows: DataFrame, pool: DataFrame, negatives: int = 7, seed: int = 42) -> DataFrame:
    """split, query_id, positive_id, copy_no, slot, document_id: `negatives` distinct ones of the pair's pool, drawn anew for each copy."""
    key = [*PAIR, "copy_no"]
    x = rows.join(pool.select(*PAIR, "document_id"), list(PAIR))
    slot = F.row_number().over(W.partitionBy(*key).orderBy(order_key(seed, *key, "document_id"), "document_id"))
    return x.withColumn("slot", slot).where(F.col("slot") <= negatives).select(*key, "slot", "document_id")


def wide(rows: DataFrame, keys: list[str], negatives: int, column: str = "document_id") -> DataFrame:
    """negative_1 .. negative_K beside the keys."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == i + 1, F.col(column))).alias(f"negative_{i + 1}") for i in range(negatives)])


def with_texts(rows: DataFrame, documents: DataFrame, negatives: int = 7) -> DataFrame:
    """Adds `document` to training rows; rows of which any text is missing or empty go, and are not replaced."""
    texts = documents.where("document is not null and document <> ''").groupBy("split", "document_id").agg(F.min("document").alias("document"))
    x = rows.join(texts, ["split", "document_id"]).join(texts.select("split", F.col("document_id").alias("positive_id"), F.col("document").alias("positive")), ["split", "positive_id"])
    return x.withColumn("__n", F.count("*").over(W.partitionBy(*PAIR, "copy_no"))).where(F.col("__n") == negatives).drop("__n")


def vetoed_triples(scored: DataFrame, negatives: int = 7) -> DataFrame:
    """Rows (row_id, neg_no, pos_score, neg_score) -> adds survives (strictly under the positive), survivors, kept."""
    x = scored.withColumn("survives", F.col("neg_score") < F.col("pos_score"))
    x = x.withColumn("survivors", F.sum(F.col("survives").cast("int")).over(W.partitionBy("row_id")))
    return x.withColumn("kept", F.col("survivors") >= negatives)


def triple_target(vetoed: DataFrame) -> DataFrame:
    """One row: usable, negatives_in, negatives_vetoed, risk, short, target (scaled from CALIBRATION, half to even)."""
    usable, risk, goal = CALIBRATION
    a = vetoed.agg(
        F.count_distinct(F.when(F.col("kept"), F.col("row_id"))).alias("usable"),
        F.count("*").alias("negatives_in"),
        F.coalesce(F.sum((~F.col("survives")).cast("int")), F.lit(0)).cast("bigint").alias("negatives_vetoed"),
        F.count_distinct(F.when(~F.col("kept"), F.col("row_id"))).alias("short"),
    ).withColumn("risk", F.col("negatives_vetoed") / F.greatest("negatives_in", F.lit(1)))
    scale = F.sqrt("usable") * (F.lit(1.0).cast("double") - F.col("risk")) / F.lit(usable**0.5 * (1 - risk))
    return a.withColumn("target", F.bround(F.lit(float(goal)) * scale).cast("bigint"))


def upsampled_triples(vetoed: DataFrame, target: DataFrame, negatives: int = 7, seed: int = 42) -> DataFrame:
    """cycle, row_id, slot, neg_no: kept rows in order, again and again up to the target; `negatives` survivors each. No kept rows: nothing."""
    kept = vetoed.where("kept and survives")
    rows = numbered(kept.select("row_id").distinct(), "row_id", by=()).drop("n")
    cycles = rows.crossJoin(F.broadcast(target.select("target", "usable")))
    cycles = cycles.where("usable > 0 and target > at").select("row_id", F.explode(F.expr("sequence(0L, (target - 1 - at) div usable)")).alias("cycle"))
    slot = F.row_number().over(W.partitionBy("cycle", "row_id").orderBy(order_key(seed, "cycle", "row_id", "neg_no"), "neg_no"))
    return cycles.join(kept.select("row_id", "neg_no"), "row_id").withColumn("slot", slot).where(F.col("slot") <= negatives).select("cycle", "row_id", "slot", "neg_no")


def batch_plan(rows: DataFrame, source: str, order: list[str], size: int, seed: int = 42) -> DataFrame:
    """Adds batch_in_source and batch_order: whole single-source batches in a shuffled order, each source in proportion to its rows."""
    x = numbered(rows, *order, by=(source,)).withColumn("batch_in_source", F.floor(F.col("at") / size).cast("int")).drop("at", "n")
    batches = x.select(source, "batch_in_source").distinct().withColumn("key", order_key(seed, source, "batch_in_source"))
    batches = numbered(batches, "key", source, by=(), place="batch_order").drop("n", "key")
    return x.join(batches, [source, "batch_in_source"])
