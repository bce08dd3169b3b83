"""What the operators of this subpackage share: the word rule, fresh column names and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """For each name one that no column has (compared without case), so that helper columns never clash with the input's."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        n = f"__{name}"
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


#: Bytes of an Arrow batch to or from Python. A batch lies several times in the memory of the JVM (vectors double as they grow) and of the worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_BYTES at most, or one longer row. A smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def named(df: DataFrame, column: str) -> str:
    """The name as the table has it, for Arrow, which tells case apart."""
    return column if column in df.columns else next(c for c in df.columns if c.lower() == column.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where the session has none (tests), a temporary one is set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="siltstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Writes `df` into the shared folder and reads it again: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame | None) -> None:
    """Deletes the files of a table that `written` made and nothing reads any more."""
    if df is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
