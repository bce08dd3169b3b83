"""Values of the training losses over rows of scores, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.vectors import argmax, clipped, log_softmax, logsumexp, minmax, total


def kl(teacher: Column, student: Column, tau_teacher: float = 0.3, tau_student: float = 0.3) -> Column:
    """KL(teacher || student) of one row, both through a softmax."""
    return total(F.zip_with(log_softmax(teacher, tau_teacher), log_softmax(student, tau_student), lambda t, s: F.exp(t) * (t - s)))


def nce(teacher: Column, student: Column, tau: float = 0.05, threshold: float | None = 0.6) -> Column:
    """InfoNCE of one row: the label is the teacher's best; others whose teacher score is over the threshold are masked."""
    best = argmax(teacher)
    logits = F.transform(student, lambda s: s / F.lit(float(tau)))
    if threshold is None:
        masked = logits
    else:
        masked = F.zip_with(logits, F.transform(teacher, lambda t, i: (t > F.lit(float(threshold))) & (i + 1 != best)), lambda x, m: F.when(~m, x))
    return logsumexp(masked) - F.element_at(logits, best.cast("int"))


def row_quantiles(rows: DataFrame, key: str, xs: str, p: float) -> DataFrame:
    """key, low, high: exact linear quantiles p and 1 - p of each row's list."""
    x = rows.select(key, F.explode(xs).alias("x")).groupBy(key)
    return x.agg(F.expr(f"percentile(x, {p}D)").alias("low"), F.expr(f"percentile(x, {1 - p}D)").alias("high"))


def quantile(xs: Column, p: float) -> Column:
    """Linear quantile of a list that has no nulls."""
    x, place = F.array_sort(xs), F.lit(float(p)) * (F.size(xs) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(x, low), F.get(x, F.least(low + 1, F.size(xs) - 1))
    return a + (b - a) * (place - low)


def mixed_loss(rows: DataFrame, teacher: str = "teacher", student: str = "student", *, tau_teacher=0.3, tau_student=0.3, w_kl=1.0, w_nce=0.1, tau_nce=0.05, threshold=0.6, normalize=True, clip_pct=0.0, size_average=True) -> DataFrame:
    """One row: n, kl, nce, loss; means over the rows as one batch. Both lists are min-max scaled first, the teacher's after a cut at its quantiles clip_pct and 1 - clip_pct. Without size_average kl is the sum over the rows; nce stays a mean."""
    told = F.col(teacher)
    if clip_pct > 0:
        told = clipped(told, quantile(told, clip_pct), quantile(told, 1 - clip_pct))
    t, s = minmax(told), minmax(F.col(student)) if normalize else F.col(student)
    x = rows.select(t.alias("t"), s.alias("s")).select(kl(F.col("t"), F.col("s"), tau_teacher, tau_student).alias("kl"), nce(F.col("t"), F.col("s"), tau_nce, threshold).alias("nce"))
    return x.agg(F.count("*").alias("n"), (F.avg if size_average else F.sum)("kl").alias("kl"), F.avg("nce").alias("nce")).withColumn("loss", F.lit(float(w_kl)) * F.col("kl") + F.lit(float(w_nce)) * F.col("nce"))
