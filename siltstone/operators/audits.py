"""Audits of mined and of trained-on negatives by an independent scorer."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.judging import PAIR
from siltstone.operators.topk import QUERY


def mining_audit(rows: DataFrame, top: int = 10) -> DataFrame:
    """rows (pair, source, neg_rank, document_id, score, positive_score; score null: no text) -> a row a split.

    The first `top` of each arm; pairs with a short arm, no positive score, fewer than three scored texts or an arm
    without a score are passed over. A false negative scores strictly over the positive. Means of rows, to 4 places.
    """
    x = rows.where(F.col("neg_rank") <= top)
    arm = lambda s, what: F.when(F.col("source") == s, what)
    over = (F.col("score") > F.col("positive_score")).cast("double")
    per = x.groupBy(*PAIR).agg(
        F.max("positive_score").alias("ps"),
        *[F.count(arm(s, F.lit(1))).alias(f"{s}_n") for s in ("mv", "dense")],
        *[F.count(arm(s, F.col("score"))).alias(f"{s}_scored") for s in ("mv", "dense")],
        *[F.avg(arm(s, over)).alias(f"{s}_fn") for s in ("mv", "dense")],
        *[F.avg(arm(s, F.col("score"))).alias(f"{s}_hard") for s in ("mv", "dense")],
        F.count_distinct(F.when(F.col("score").isNotNull(), F.col("document_id"))).alias("texts"),
        (F.lit(2 * top) - F.count_distinct("document_id")).alias("both"),
    )
    return _mining_report(per.where(f"mv_n = {top} and dense_n = {top} and ps is not null and texts >= 2 and mv_scored > 0 and dense_scored > 0"), top)


def mining_audit_by_query(arms: DataFrame, positives: DataFrame, top: int = 10) -> DataFrame:
    """`mining_audit` from arms (split, query_id, source, neg_rank, document_id, score), which all pairs of a query share, and positives (split, query_id, positive_score).

    A query's negatives are gathered once; what a pair moves is its positive's score.
    """
    arm = lambda s, what: F.when(F.col("source") == s, what)
    per = arms.where(F.col("neg_rank") <= top).groupBy(*QUERY).agg(
        *[F.count(arm(s, F.lit(1))).alias(f"{s}_n") for s in ("mv", "dense")],
        *[F.collect_list(arm(s, F.col("score"))).alias(f"{s}_scores") for s in ("mv", "dense")],
        *[F.avg(arm(s, F.col("score"))).alias(f"{s}_hard") for s in ("mv", "dense")],
        F.size(F.collect_set(F.when(F.col("score").isNotNull(), F.col("document_id")))).alias("texts"),
        (F.lit(2 * top) - F.size(F.collect_set("document_id"))).alias("both"),
    )
    per = per.where(f"mv_n = {top} and dense_n = {top} and texts >= 2 and size(mv_scores) > 0 and size(dense_scores) > 0")
    over = lambda s: F.size(F.filter(f"{s}_scores", lambda x: x > F.col("positive_score"))) / F.size(f"{s}_scores")
    pairs = positives.where("positive_score is not null").select(*QUERY, "positive_score").join(per, list(QUERY))
    return _mining_report(pairs.withColumns({f"{s}_fn": over(s) for s in ("mv", "dense")}), top)


def _mining_report(per: DataFrame, top: int) -> DataFrame:
    """Means of audited pairs, a row a split."""
    mean = lambda c, name: F.round(F.avg(F.round(c, 12)), 4).alias(name)
    return per.groupBy("split").agg(
        F.count("*").alias("n"),
        mean("mv_fn", "mv_false_negative_rate"),
        mean("dense_fn", "dense_false_negative_rate"),
        mean("mv_hard", "mv_mean_negative_score"),
        mean("dense_hard", "dense_mean_negative_score"),
        mean(F.col("both") / F.lit(top), "set_overlap"),
    )


def gate_audit(rows: DataFrame) -> DataFrame:
    """rows (split, pos, neg: list) -> split, rows, fn_rate (of all cells), pos_at_1, margin; to 4 places."""
    over = F.size(F.filter("neg", lambda n: n > F.col("pos")))
    top = F.array_max("neg")
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.round(F.sum(over) / F.sum(F.size("neg")), 4).alias("fn_rate"),
        F.round(F.avg((top < F.col("pos")).cast("double")), 4).alias("pos_at_1"),
        F.round(F.avg(F.round(F.col("pos") - top, 12)), 4).alias("margin"),
    )


def weighted(report: DataFrame, count: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of per-split values (as rounded) weighted by their row counts."""
    return report.groupBy(*(by or [])).agg(F.sum(count).alias(count), *[F.round(F.sum(F.col(c) * F.col(count)) / F.sum(count), 6).alias(c) for c in columns])


def pivoted(report: DataFrame, by: str, values: list[str], columns: list[str], key: str = "split") -> DataFrame:
    """A row for each key with {value}_{column} for each of `values` of the column `by`, in this order; null where a directory lacks the key."""
    wide = report.groupBy(key).pivot(by, values).agg(*[F.first(c).alias(c) for c in columns])
    names = [f"{v}_{c}" for v in values for c in columns]
    return wide.select(key, *[F.col(f"`{n if len(columns) > 1 else n.rsplit('_' + columns[0], 1)[0]}`").alias(n) for n in names])


# The widths and places of the audits' printed lines.
MINING_LINE = (("%-10s", "split", None), ("%4s", "n", None), ("%7s%%", "mv_false_negative_rate", 1), ("%10s%%", "dense_false_negative_rate", 1), ("%8s", "mv_mean_negative_score", 3), ("%10s", "dense_mean_negative_score", 3), ("%6s%%", "set_overlap", 1))
MINING_FORM = "{} {} | {} {} | {} {} | {}"
GATE_CELL = "%9s%% fn %5s%%@1"
GATE_NAME, GATE_TOTAL, GATE_WIDTH = "%24s", "WEIGHTED %-24s fn=%s%%  pos@1=%s%%", 24


def places(c: Column, n: int) -> Column:
    """A number with n decimal places, rounded by its exact binary value, halves to even.

    Java rounds the double nearest to half a unit down, whatever its exact value; it is told apart here.
    """
    half = 0.5 * 10**-n
    if Decimal(half) > Decimal(5).scaleb(-n - 1):
        c = F.when(F.abs(c) == half, F.signum(c) * 2 * half).otherwise(c)
    return F.call_function("format_number", c, F.lit(f"0.{'0' * n}"))


def mining_lines(report: DataFrame) -> DataFrame:
    """line_no, line: `mining_audit` as it is printed, a line a split in order of name, a rule, and the means weighted by n.

    The means are of the report's rounded values. The report has a row a split; an empty one gives no lines.
    """
    named = [c for _, c, _ in MINING_LINE[2:]]
    total = report.agg(F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in named]).where("n is not null")
    rows = report.select("split", "n", *named).withColumn("line_no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("split")))
    last = total.withColumn("split", F.lit("WEIGHTED")).withColumn("line_no", F.lit(2**31 - 1))
    shares = {c for f, c, p in MINING_LINE if f.endswith("%%")}
    value = lambda c, p: F.col(c).cast("string") if p is None else places(F.col(c) * 100 if c in shares else F.col(c), p)
    form = MINING_FORM.format(*[f for f, _, _ in MINING_LINE])
    lines = rows.unionByName(last).select("line_no", F.format_string(form, *[value(c, p) for _, c, p in MINING_LINE]).alias("line"))
    rule = total.select(F.lit(2**31 - 2).alias("line_no"), F.lit("-" * 74).alias("line"))
    return lines.unionByName(rule).select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("line_no")).cast("bigint").alias("line_no"), "line")


def gate_lines(report: DataFrame, dirs: list[str]) -> DataFrame:
    """line_no, line: reports of `gate_audit` with a column `dir`, as they are printed: the directories' names, a line a split with a cell for each directory (blank where it lacks the split), and a weighted line a directory.

    A directory without rows gets no weighted line.
    """
    wide = pivoted(report, "dir", dirs, ["fn_rate", "pos_at_1"])
    cell = lambda d: F.when(F.col(f"{d}_fn_rate").isNotNull(), F.format_string(GATE_CELL, places(F.col(f"{d}_fn_rate") * 100, 1), places(F.col(f"{d}_pos_at_1") * 100, 1))).otherwise(" " * GATE_WIDTH)
    splits = wide.select(F.lit(1).alias("part"), F.col("split").alias("key"), F.concat(F.format_string("%-10s", "split"), *[cell(d) for d in dirs]).alias("line"))
    mean = lambda c: places(F.sum(F.col(c) * F.col("rows")) / F.sum("rows") * 100, 1)
    totals = report.groupBy("dir").agg(mean("fn_rate").alias("fn"), mean("pos_at_1").alias("p"))
    place = F.format_string("%09d", F.array_position(F.array(*[F.lit(d) for d in dirs]), F.col("dir")))
    totals = totals.where(F.col("dir").isin(dirs)).select(F.lit(2), place, F.format_string(GATE_TOTAL, "dir", "fn", "p"))
    head = report.sparkSession.range(1).select(F.lit(0), F.lit(""), F.concat(F.format_string("%-10s", F.lit("split")), *[F.format_string(GATE_NAME, F.lit(d)) for d in dirs]))
    return splits.union(totals).union(head).select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("part", "key")).cast("bigint").alias("line_no"), "line")
