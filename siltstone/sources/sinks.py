"""Writers. Spark's commit protocol makes each of them atomic; a finished output is not written again unless asked."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.readers import listed


def done(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in listed(spark, path)


def write_jsonl(df: DataFrame, path: str, again: bool = False, compression: str = "none") -> bool:
    """JSON lines in UTF-8; null fields are left out. compression: of the part files, 'gzip' or such; Spark reads both alike."""
    if done(df.sparkSession, path) and not again:
        return False
    df.write.mode("overwrite").json(path, compression=compression)
    return True


def write_sources(df: DataFrame, folder: str, source: str = "split") -> None:
    """One folder train_{source}.jsonl for each source; the sources are counted, not the rows."""
    for r in df.select(source).distinct().orderBy(source).collect():
        df.where(F.col(source).eqNullSafe(F.lit(r[0]))).drop(source).write.mode("overwrite").json(f"{folder}/train_{r[0]}.jsonl")


def _path(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def write_split(df: DataFrame, folder: str, split: str, first: int = 0, compression: str = "snappy") -> int:
    """Files {folder}/{split}-00000.parquet and so on (numbered from `first`), one for each partition of `df` that has rows, in order; gives their number.

    They are written beside and renamed when all are there. compression: zstd finds what repeats over longer stretches, as ids do in many judgements.
    """
    spark = df.sparkSession
    beside = f"{folder}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(beside, compression=compression)
    names = [n for n in listed(spark, beside) if n.startswith("part-")]
    fs, _ = _path(spark, beside)
    for i, n in enumerate(names):
        fs.rename(_path(spark, f"{beside}/{n}")[1], _path(spark, f"{folder}/{split}-{first + i:05d}.parquet")[1])
    fs.delete(_path(spark, beside)[1], True)
    return len(names)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file in UTF-8, written over what was there."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `staged` made and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = _path(df.sparkSession, folder)
        fs.delete(p, True)


def write_lists(queries: DataFrame, documents: DataFrame, train: DataFrame, folder: str) -> None:
    for name, df in (("queries", queries), ("documents", documents), ("train", train)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session has none, a temporary one is set in local mode; a cluster must name it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage's output into the shared folder and reads it again.

    Later stages then plan over a table, not over all that made it, and a lost executor costs no recomputation.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_rows(df: DataFrame, *columns: str):
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


# The escapes of JSON that have a letter.
ESCAPES = {r"\u0008": r"\b", r"\u0009": r"\t", r"\u000a": r"\n", r"\u000c": r"\f", r"\u000d": r"\r"}


def ascii_string(text: Column) -> Column:
    """A text as a JSON string in ASCII: all but printable ASCII as UTF-16 units in lower-case hexadecimals, or by letter."""

    def run(r: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(r, "UTF-16BE"))), "(.{4})", r"\\u$1")
        for unit, letter in ESCAPES.items():
            units = F.replace(units, F.lit(unit), F.lit(letter))
        return F.when(r.rlike("^[ -~]"), F.regexp_replace(r, r'([\\"])', r"\\$1")).otherwise(units)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]+"), 0), run), ""), F.lit('"'))


def _ascii_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        value = ascii_string(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        value = c.cast("string")
    elif isinstance(kind, T.ArrayType):
        value = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _ascii_value(x, kind.elementType)), ", "), F.lit("]"))
    else:
        raise TypeError(f"no ASCII JSON for {kind.simpleString()}")
    return F.coalesce(value, F.lit("null"))


def json_fields(df: DataFrame, *columns: str) -> Column:
    """The fields of a JSON object without its braces; null fields are left out, without any it is null."""
    whole = F.to_json(F.struct(*columns))
    return F.nullif(F.substr(whole, F.lit(2), F.length(whole) - 2), F.lit(""))


def ascii_fields(df: DataFrame, *columns: str, skip_null: bool = False) -> Column:
    """The same in ASCII, with a space after each comma and colon. Nulls are written; with `skip_null` such fields are left out."""
    fields = []
    for n in columns:
        c = F.col(f"`{n}`")
        field = F.concat(ascii_string(F.lit(n)), F.lit(": "), _ascii_value(c, df.schema[n].dataType))
        fields.append(F.when(c.isNotNull(), field) if skip_null else field)
    return F.nullif(F.concat_ws(", ", *fields), F.lit(""))


def ascii_json_rows(df: DataFrame, *columns: str, skip_null: bool = False) -> DataFrame:
    """One JSON object a row in ASCII, with a space after each comma and colon, fields in order of `columns` (all, if none is named).

    Texts, integers, booleans and lists of them. Nulls are written; with `skip_null` such fields are left out.
    """
    fields = ascii_fields(df, *(columns or df.columns), skip_null=skip_null)
    return df.select(F.concat(F.lit("{"), F.coalesce(fields, F.lit("")), F.lit("}")).alias("json"))


def write_ascii_jsonl(df: DataFrame, path: str, again: bool = False, skip_null: bool = False, compression: str = "none") -> bool:
    """JSON lines in ASCII, as `ascii_json_rows` makes them. compression: as in `write_jsonl`."""
    if done(df.sparkSession, path) and not again:
        return False
    write_lines(ascii_json_rows(df, skip_null=skip_null), path, compression)
    return True


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """A table of one text column as lines, over what was there. lz4 (as Hadoop frames it) searches long for matches: lines that repeat one another take less space and less time than with gzip."""
    lines.write.mode("overwrite").option("io.compression.codec.lz4.use.lz4hc", "true").text(path, compression=compression)


def with_shared_fields(shared: DataFrame, by: list[str], head: list[str], tail: list[str], fields=json_fields) -> DataFrame:
    """by, head, tail: the first and the last fields of the lines of many rows that share a row of `shared`, made into JSON once for all of them (`shared_line`)."""
    return shared.select(*by, fields(shared, *head).alias("head"), fields(shared, *tail).alias("tail"))


def shared_line(df: DataFrame, *own: str, fields=json_fields) -> Column:
    """The JSON object of a row with `head` and `tail` of `with_shared_fields`, its own fields between them."""
    comma = ", " if fields is ascii_fields else ","
    return F.concat(F.lit("{"), F.concat_ws(comma, "head", fields(df, *own), "tail"), F.lit("}"))
