"""Readers of the stages' files. Paths may be on any file system that Spark reads; nothing is opened locally."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; empty if it is not there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


#: Columns that give the order of rows in a split's files.
FILE_ORDER = ("file", "row")


def scan_split(spark: SparkSession, root: str, config: str, split: str, ordered: bool = False) -> DataFrame:
    """Parquet files `{root}/{config}/{split}-*.parquet` with a split column; an error if there is none.

    ordered: adds FILE_ORDER, the file's name and the row's place in it, by which first and last rows are told.
    """
    names = [n for n in listed(spark, f"{root}/{config}") if n.startswith(f"{split}-") and n.endswith(".parquet")]
    if not names:
        raise FileNotFoundError(f"no Parquet files for split {split} in {root}/{config}")
    rows = spark.read.parquet(*[f"{root}/{config}/{n}" for n in names])
    if ordered:
        rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("split", F.lit(split))


def read_pairs(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Mined pairs from JSON lines; rows of other splits are passed over."""
    rows = spark.read.schema(schema.PAIRS).json(path)
    return rows.where(F.col("split").isin(splits)) if splits else rows


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRIPLES).json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return (spark.read.schema(ddl) if ddl else spark.read).json(path)


def read_parts(spark: SparkSession, path: str, split: str | None = None, ddl: str | None = None) -> DataFrame:
    """Candidate or judge parts, a table partitioned by (split, shard): only the split's files are listed and read.

    A table all of whose shards are empty can be read with a schema only.
    """
    parts = (spark.read.schema(ddl) if ddl else spark.read).parquet(path)
    return parts if split is None else parts.where(F.col("split") == split)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Dense candidate parts (`qids`, `ids`, `scores` in .npz files named {split}_{shard} or {split}) -> long rows, padding dropped."""

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                stem = name.rsplit("/", 1)[1].removesuffix(".npz")
                m = re.fullmatch(r"(.*)_(\d+)", stem)
                with np.load(io.BytesIO(content)) as z:
                    q, ids, scores = z["qids"], z["ids"], z["scores"]
                ok = (ids >= 0) & np.isfinite(scores)
                yield pd.DataFrame({"split": m[1] if m else stem, "shard": int(m[2]) if m else 0, "query_id": np.repeat(q, ids.shape[1]).reshape(ids.shape)[ok], "document_id": ids[ok], "score": scores[ok].astype(float)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(rows, schema.CANDIDATES)


def latest_snapshot(spark: SparkSession, root: str, name: str, decontaminated_root: str | None = None) -> str:
    """The last snapshot folder of a dataset; names that end in -decontaminated are looked up in their own root."""
    base = decontaminated_root if decontaminated_root and name.endswith("-decontaminated") else root
    found = listed(spark, f"{base}/{name}/snapshots")
    if not found:
        raise FileNotFoundError(f"no snapshot of {name} in {base}")
    return f"{base}/{name}/snapshots/{found[-1]}"


def official_split(name: str) -> str:
    """The split that a benchmark dataset is evaluated on."""
    return {"msmarco": "dev"}.get(name, "test")


def read_kind(spark: SparkSession, snapshot: str, kind: str, split: str) -> DataFrame:
    """corpus, queries or qrels of a dataset in one of three layouts: one Parquet file, JSON lines, or a folder of Parquet shards (those of the split first)."""
    names = listed(spark, snapshot)
    for stem in (kind, f"{kind}/{split}"):
        folder, _, last = stem.rpartition("/")
        there = listed(spark, f"{snapshot}/{folder}") if folder else names
        for ending, read in ((".parquet", spark.read.parquet), (".jsonl", spark.read.json)):
            if last + ending in there:
                return read(f"{snapshot}/{stem}{ending}")
    shards = [n for n in listed(spark, f"{snapshot}/{kind}") if n.endswith(".parquet")]
    own = [n for n in shards if n.startswith(f"{split}-")] or shards
    if not own:
        raise FileNotFoundError(f"no {kind} in {snapshot}")
    return spark.read.parquet(*[f"{snapshot}/{kind}/{n}" for n in own])


def either(df: DataFrame, *names: str, kind: str = "string"):
    """The first of these columns that is there and not null, cast."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return (F.coalesce(*there) if there else F.lit(None)).cast(kind)


def load_dataset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, text), judged queries (query_id, text), qrels (query_id, doc_id, rel > 0), with string ids."""
    from siltstone.functions.text import titled

    rels = qrels.select(either(qrels, "query-id", "query_id").alias("query_id"), either(qrels, "corpus-id", "doc_id").alias("doc_id"), F.coalesce(either(qrels, "score", "relevance", "rel", kind="int"), F.lit(0)).alias("rel")).where("rel > 0")
    asked = queries.select(either(queries, "_id", "id").alias("query_id"), F.coalesce(either(queries, "text"), F.lit("")).alias("text")).join(rels.select("query_id").distinct(), "query_id", "left_semi")
    return corpus.select(either(corpus, "_id", "id").alias("doc_id"), titled(either(corpus, "title"), either(corpus, "text")).alias("text")), asked, rels


def read_training(spark: SparkSession, folder: str) -> DataFrame:
    """All train_{source}.jsonl of a folder, or train.jsonl, with `source`."""
    names = listed(spark, folder)
    own = [n for n in names if re.fullmatch(r"train_.*\.jsonl", n)] or [n for n in names if n == "train.jsonl"]
    if not own:
        raise FileNotFoundError(f"no training rows in {folder}")
    rows = spark.read.json([f"{folder}/{n}" for n in own])
    return rows.withColumn("source", F.regexp_extract(F.input_file_name(), r"train_?([^/]*)\.jsonl", 1))


def negatives(rows: DataFrame) -> list[str]:
    """negative_* columns in order of their number."""
    return sorted((c for c in rows.columns if re.fullmatch(r"negative_\d+", c)), key=lambda c: int(c.split("_")[1]))


def read_lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables of a distillation set."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("queries", "documents", "train")}


