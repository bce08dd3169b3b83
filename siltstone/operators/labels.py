"""Labels, positives and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.topk import QUERY
from siltstone.sources.readers import FILE_ORDER


def first_element(labels: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with the annotated positive, element 0 of document_ids. Lenient: rows with an empty or null list go; strict: an empty list is an error."""
    if strict:
        return labels.withColumn("document_id", F.element_at("document_ids", 1))
    return labels.withColumn("document_id", F.get("document_ids", F.lit(0))).where("document_id is not null")


def distinct_positives(labels: DataFrame) -> DataFrame:
    """Each positive of a query once, in order of first sight (label_pos from 1)."""
    first = labels.groupBy("split", "query_id", "document_id").agg(F.min("label_pos").alias("seen"))
    return first.withColumn("label_pos", F.row_number().over(W.partitionBy(*QUERY).orderBy("seen", "document_id"))).drop("seen")


def capped_gold(labels: DataFrame, cap: int = 12) -> DataFrame:
    """The first `cap` label rows of a query; repeated rows count."""
    return labels.withColumn("gold_pos", F.row_number().over(W.partitionBy(*QUERY).orderBy("label_pos"))).where(F.col("gold_pos") <= cap)


def excluded(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates that are no positive of their query."""
    return candidates.join(positives.select("split", "query_id", "document_id"), ["split", "query_id", "document_id"], "left_anti")


def in_file_order(labels: DataFrame) -> DataFrame:
    """Numbers the label rows of a query by their place in the files (FILE_ORDER) as label_pos, from 1."""
    return labels.withColumn("label_pos", F.row_number().over(W.partitionBy(*QUERY).orderBy(*FILE_ORDER)))


def one_each(rows: DataFrame, keys: list[str], value: str, last: bool = False) -> DataFrame:
    """One value for each key: the first or last in order of the files, if the rows carry it (FILE_ORDER); else the least or greatest."""
    if set(FILE_ORDER) <= set(rows.columns):
        pick = (F.max_by if last else F.min_by)(value, F.struct(*FILE_ORDER))
    else:
        pick = (F.max if last else F.min)(value)
    return rows.groupBy(*keys).agg(pick.alias(value))


def looked_up(rows: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds each document's text; null if it is not there. Of repeated ids the first wins (`one_each`)."""
    once = one_each(documents, ["split", "document_id"], "document")
    return rows.join(once.select("split", F.col("document_id").alias(key), "document"), ["split", key], "left")
