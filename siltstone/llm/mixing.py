"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sources in code-point order, null last, get the repeating weights and share `total_ratio` of all words.
A target stops at `cap` times its source's size; the excess is shared again by weight. The fixed point is
found in closed form: with sources in order of capacity per weight, those that stop are the first ones.

Every document of a source expects target / source_size copies. The prefix sum of the expected copies,
plus one offset drawn from the seed and the source, is cut at the integers; a document is emitted once for
each integer it crosses. Documents stand in order of size class (digits and two leading digits), hash salt,
size and id, so that each size is taken in proportion. No window holds a whole source: counts by (source,
class, salt) are summed first and only their prefix sums are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import n_words, table, written

WEIGHTS, TOTAL_RATIO, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-7"


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_ratio=TOTAL_RATIO, cap=CAP) -> DataFrame:
    """`sizes` (source, source_size), a row a source -> adds src (rank from 0), weight, target.

    Sources without words get target 0. The windows over all sources hold one row each.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    by_room = every.orderBy(F.col("room") / F.col("weight"), "src")
    before, rest = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(0, W.unboundedFollowing)
    x = (
        sizes.withColumn("src", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", w)
        .withColumn("room", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(total_ratio)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("share", F.sum("weight").over(rest))
        .withColumn("stops", F.col("room") * F.col("share") <= F.col("weight") * F.col("left"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("room"))).over(every), F.lit(0.0)))
        .withColumn("share", F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every))
        .withColumn("target", F.when(F.col("stops"), F.col("room")).otherwise(F.col("weight") * F.col("left") / F.col("share")))
    )
    return x.select("source", "source_size", "src", "weight", "target")


def _copies(docs: DataFrame, carry: bool, weights, total_ratio, cap, seed) -> DataFrame:
    """doc_id, size, source_size, target, copies of each row, and with `carry` the whole row as `row`."""
    hexed = lambda s, a, n: F.substring(F.md5(F.concat_ws("|", F.lit(seed), s)), a, n)
    digits = F.col("size").cast("string")
    whole = [F.struct("*").alias("row")] if carry else []
    sized = docs.select(*whole, "doc_id", "source", n_words(F.col("text")).alias("size")).select(
        *(["row"] if carry else []),
        "doc_id",
        "source",
        "size",
        (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).alias("class"),
        hexed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 1, 2).alias("salt"),
    )
    sized = sized if carry else written(sized, "mix-sizes")
    groups = sized.groupBy("source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    groups = written(groups, "mix-groups")
    targets = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_ratio, cap)
    up_to = W.partitionBy("src").orderBy("class", "salt").rowsBetween(W.unboundedPreceding, -1)
    offset = F.conv(hexed(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = (
        groups.withColumnRenamed("source", "s")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("s", F.col("class").alias("c"), F.col("salt").alias("x"), "source_size", "target", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("start"), offset.alias("offset"), rate.alias("rate"))
    )
    inside = W.partitionBy("source", "class", "salt").orderBy("size", "doc_id")
    ranked = sized.withColumn("at", F.row_number().over(inside) - 1)
    cut = lambda i: F.floor(F.col("offset") + F.col("rate") * i.cast("double"))
    i = F.col("start") + F.col("at")
    return ranked.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("salt") == F.col("x"))).withColumn("copies", cut(i + 1) - cut(i))


def mix(docs: DataFrame, *, weights=WEIGHTS, total_ratio=TOTAL_RATIO, cap=CAP, seed=SEED) -> DataFrame:
    """documents (doc_id, text, source; other columns are ignored) -> doc_id, size, source_size, target, taken, copies; a row a document.

    Null text is empty: size 0, taken 0. Null source is a source of its own, the last. Null or repeated ids are
    rows like any other; rows that agree in source, size and id are interchangeable. An empty table gives no rows.
    """
    rows = _copies(docs, False, weights, total_ratio, cap, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, *, weights=WEIGHTS, total_ratio=TOTAL_RATIO, cap=CAP, seed=SEED) -> DataFrame:
    """The mix itself: all columns of each document, as many times as it is taken. Cases as in `mix`."""
    rows = _copies(docs, True, weights, total_ratio, cap, seed).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("copies")


#: The same in DuckDB, over the view documents.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, size, strlen(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS class,
         substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS src FROM sized GROUP BY source
), rooms AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(src % 3 + 1)::INT] AS weight, source_size::DOUBLE * {CAP}::DOUBLE AS room,
         (sum(source_size) OVER ())::DOUBLE * {TOTAL_RATIO}::DOUBLE AS total
  FROM sizes
), marked AS (
  SELECT *, room * sum(weight) OVER (ORDER BY room / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= weight * (total - coalesce(sum(room) OVER (ORDER BY room / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stops
  FROM rooms
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN room ELSE weight * (total - coalesce(sum(room) FILTER (WHERE stops) OVER (), 0))
         / sum(weight) FILTER (WHERE NOT stops) OVER () END AS target,
         ('0x' || substr(md5('{SEED}|' || coalesce('s' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM marked
), ranked AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY class, salt, size, doc_id ASC NULLS FIRST) AS i
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(u + rate * i::DOUBLE) - floor(u + rate * (i - 1)::DOUBLE)) * size)::BIGINT AS taken
FROM ranked
"""
