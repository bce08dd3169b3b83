"""A Python data source for padded candidate parts: files {split}_{shard:03d}.npz with `qids` (n), `ids` and `scores` (n x width).

Reading: a partition for each part; filters on split and shard choose parts before any file is opened, and rows come in
slices, so a task holds a slice of its part. Padding (ids under 0, scores that are not finite) is no row. A file
{split}.npz of the older layout is shard 0, where the split has no other parts.

Writing: a task writes its parts under _temporary and reports them; the commit renames all of them, after a check that no part
came from two tasks or is there already (unless the mode is overwrite, which replaces the parts written and no others). An
abort removes the job's folder, whatever a failed task left. Rows of a part must come together, queries and
their documents in order (`write_padded` sees to it); a task holds a slice of a part, the rest waits in local files.

Paths are those that pyarrow opens (local, hdfs, s3); `readers.read_npz` reads parts from any store that Spark reads.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from siltstone import schema

FORMAT = "padded_parts"
#: Candidates in a batch that is read.
SLICE = 1 << 18


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; file:/x is the same as /x."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def parts_in(path: str) -> dict[tuple[str, int], str]:
    """(split, shard) -> file of all parts in a folder."""
    fs, root = opened(path)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.path.endswith(".npz"))
    numbered = {(m[1], int(m[2])): n for n in names if (m := re.fullmatch(r"(.*)_(\d+)\.npz", n.rsplit("/", 1)[-1]))}
    splits = {s for s, _ in numbered}
    older = {(s, 0): n for n in names if n not in numbered.values() and (s := n.rsplit("/", 1)[-1].removesuffix(".npz")) not in splits}
    return numbered | older


@dataclass
class Part(InputPartition):
    split: str
    shard: int
    file: str


class PartsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters):
        for f in filters:
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo) else None
            if values is not None and f.attribute in (("split",), ("shard",)):
                self.wanted.append((f.attribute[0], frozenset(values)))
            else:
                yield f

    def partitions(self):
        found = [Part(split, shard, file) for (split, shard), file in sorted(parts_in(self.path).items())]
        return [p for p in found if all(getattr(p, name) in values for name, values in self.wanted)] or [Part("", -1, "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z:
            with z.open("qids.npy") as q:
                qids = np.lib.format.read_array(q)
            with z.open("ids.npy") as i, z.open("scores.npy") as s:
                (n, width), id_type = _header(i)
                _, score_type = _header(s)
                step = max(1, SLICE // max(width, 1))
                for at in range(0, n, step):
                    rows = min(step, n - at)
                    ids, scores = (np.frombuffer(x.read(rows * width * t.itemsize), t).reshape(rows, width) for x, t in ((i, id_type), (s, score_type)))
                    there = (ids >= 0) & np.isfinite(scores)
                    row, _ = np.nonzero(there)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.split] * len(row), pa.string()), pa.array(np.full(len(row), partition.shard, np.int32)), pa.array(qids[at + row].astype(np.int64)), pa.array(ids[there].astype(np.int64)), pa.array(scores[there].astype(np.float64))], ["split", "shard", "query_id", "document_id", "score"])


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(f)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_column:
        raise ValueError("a part's arrays must lie row by row")
    return shape, kind


@dataclass
class Written(WriterCommitMessage):
    """(file's name, temporary file) of each part of a task."""

    files: list[tuple[str, str]]


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, kind: str, width: int):
        self.path, self.overwrite, self.kind, self.width, self.job = path, overwrite, kind, width, uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = opened(self.path)
        return fs, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator) -> Written:
        fs, _, folder = self._folder()
        files = []
        try:
            for split, shard, slices in _parts(iterator):
                fs.create_dir(folder, recursive=True)
                files.append((f"{split}_{shard:03d}.npz", f"{folder}/{uuid.uuid4().hex}.npz"))
                with fs.open_output_stream(files[-1][1]) as out:
                    padded(slices, out, self.kind, self.width)
        except BaseException:
            for _, temporary in files:
                if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
                    fs.delete_file(temporary)
            raise
        return Written(files)

    def commit(self, messages) -> None:
        fs, root, folder = self._folder()
        files = [f for m in messages if m for f in m.files]
        names = [name for name, _ in files]
        if len(set(names)) < len(names):
            raise ValueError("rows of a part came from several tasks")
        there = [n for n in names if fs.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound]
        if there and not self.overwrite:
            raise FileExistsError(f"parts are there already: {', '.join(there)}")
        for name, temporary in files:
            fs.move(temporary, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, root, folder = self._folder()
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)
        above = f"{root}/_temporary"
        if fs.get_file_info(above).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


def _parts(iterator) -> Iterator[tuple[str, int, Iterator[pa.RecordBatch]]]:
    """(split, shard, its rows in slices) of the parts in a task's rows, which must come together. A part's slices are taken before the next part is asked for."""

    def slices():
        for b in iterator:
            code, shards = b.column("split").dictionary_encode(), b.column("shard").to_numpy()
            names, split = code.dictionary.to_pylist(), code.indices.to_numpy()
            new = np.flatnonzero((split[1:] != split[:-1]) | (shards[1:] != shards[:-1])) + 1 if b.num_rows else []
            for at, end in zip([0, *new], [*new, b.num_rows]):
                if at < end:
                    yield (names[split[at]], int(shards[at])), b.slice(at, end - at)

    seen = set()
    for key, rows in groupby(slices(), key=lambda x: x[0]):
        if key in seen:
            raise ValueError(f"rows of part {key} do not come together")
        seen.add(key)
        yield *key, (r for _, r in rows)


def padded(slices: Iterable[pa.RecordBatch], out, kind: str = "float32", width: int = 0) -> None:
    """Writes the .npz file of one part to `out`: queries in order of their rows; lists are padded to the longest, or to `width`.

    How many queries there are and how long the longest list is shows at the end of the rows, so these wait in local files meanwhile, bare;
    held are a slice and a query's id and size.
    """
    score = np.dtype(kind)
    found, sizes, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None
    with tempfile.TemporaryFile() as ids, tempfile.TemporaryFile() as scores:
        for b in slices:
            q = b.column("query_id").to_numpy()
            first = np.flatnonzero(np.diff(q, prepend=q[:1] - 1 if last is None else last))
            n = np.diff(np.append(first, len(q)))
            if len(first) == 0 or first[0] > 0:  # the list of the slice before goes on
                sizes[-1][-1] += first[0] if len(first) else len(q)
            if len(first):
                found.append(q[first])
                sizes.append(n)
            last = q[-1:]
            ids.write(b.column("document_id").to_numpy().astype(np.int64).tobytes())
            scores.write(b.column("score").to_numpy().astype(score).tobytes())
        found, sizes = np.concatenate(found), np.concatenate(sizes)
        if len(np.unique(found)) < len(found):
            raise ValueError("rows of a query do not come together")
        if width and sizes.max(initial=0) > width:
            raise ValueError(f"a query has {sizes.max()} candidates, over the width of {width}")
        shape = (len(found), width or int(sizes.max(initial=0)))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("qids.npy", "w", force_zip64=True) as to:
                np.lib.format.write_array(to, found)
            for name, held, fill in (("ids", ids, np.int64(-1)), ("scores", scores, score.type(-np.inf))):
                held.seek(0)
                with z.open(f"{name}.npy", "w", force_zip64=True) as to:
                    np.lib.format.write_array_header_1_0(to, {"descr": np.lib.format.dtype_to_descr(fill.dtype), "fortran_order": False, "shape": shape})
                    step = max(1, SLICE // max(shape[1], 1))
                    for at in range(0, shape[0], step):
                        n = sizes[at : at + step]
                        rows = np.full((len(n), shape[1]), fill)
                        place = np.arange(shape[1]) < n[:, None]
                        rows[place] = np.frombuffer(held.read(int(n.sum()) * fill.itemsize), fill.dtype)
                        to.write(rows.tobytes())


class PaddedParts(DataSource):
    """Options: path; score (float32 or float64 on writing, float32 if not set); width (of the padded lists; the longest if not set)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schema.CANDIDATES

    def reader(self, schema):
        return PartsReader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return PartsWriter(self.options["path"], overwrite, self.options.get("score", "float32"), int(self.options.get("width", 0)))


def _pushed(spark: SparkSession) -> None:
    spark.dataSource.register(PaddedParts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_padded(spark: SparkSession, path: str, split: str | None = None, shard: int | None = None) -> DataFrame:
    """split, shard, query_id, document_id, score of the parts in a folder; those of one split or shard without opening the others."""
    _pushed(spark)
    rows = spark.read.format(FORMAT).load(path)
    for name, value in (("split", split), ("shard", shard)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def write_padded(df: DataFrame, path: str, *, again: bool = False, width: int = 0) -> list[tuple[str, int]]:
    """Writes candidates (split, shard, query_id, document_id, score) as padded parts; gives the parts written.

    Parts that are there are passed over, with `again` written anew; other parts stay. Lists are in order of score, then id.
    """
    spark = df.sparkSession
    _pushed(spark)
    before = parts_in(path)
    rows = df.select("split", F.col("shard").cast("int").alias("shard"), "query_id", "document_id", F.col("score").cast("double").alias("score"))
    if before and not again:  # a row a part
        rows = rows.join(spark.createDataFrame(list(before), "split string, shard int"), ["split", "shard"], "left_anti")
    rows = rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "query_id", F.round("score", 9).desc(), "document_id")
    stamp = {k: _stamp(path, f) for k, f in before.items()}
    rows.write.format(FORMAT).option("width", str(width)).mode("overwrite" if again else "append").save(path)
    return sorted(k for k, f in parts_in(path).items() if stamp.get(k) != _stamp(path, f))


def _stamp(path: str, file: str):
    fs, _ = opened(path)
    info = fs.get_file_info(file)
    return file, info.mtime_ns
