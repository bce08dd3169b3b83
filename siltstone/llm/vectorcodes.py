"""Vector code compression: one byte a part of a vector, from codebooks of integer entries, assigned by partial-distance search.

Components become integers, floor(SCALE * x), and a vector is cut into PARTS equal consecutive parts. The codebook of a part
begins as that part of the ENTRIES smallest vec_ids; in each of ROUNDS rounds every part is assigned to its nearest entry, and
entries become the floored means of their parts.

Partial-distance search: the dimensions of a part are taken in descending variance of its codebook. Distances grow by one
dimension for all (row, entry) pairs of a block at once; after each, the leading entry of each row is completed, and a mask drops
the pairs whose distance so far strictly exceeds the row's best complete distance. What ties with the best stays, so the
lowest number among the nearest is found, as by a full search.

A pass gives one row a task and entry (sums and counts), so the shuffle does not grow with the rows of a task; the driver and
the closures hold the codebooks only, PARTS x ENTRIES entries. Sums are added as decimals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowops import bounds
from siltstone.llm.common import bounded_batches, fresh, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components beyond this would not fit a sum of squares of some thousand dimensions into 64 bits; such vectors get no code.
LIMIT = 1 << 24
#: A label with at least one in HOT rows has its sum broadcast (so at most HOT sums are).
HOT = 1000
#: Rows that a step of the search works on at once, and the part of its pairs (one in SPARSE) under which it keeps the open ones only.
STEP, SPARSE = 2048, 8


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and entries of integers -> number of each row's nearest entry (ties: the lowest) and its squared distance."""
    order = np.argsort(-book.var(0), kind="stable")
    wide = 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max())) ** 2 >= 1 << 31
    x, book = (np.ascontiguousarray(a[:, order].T, np.int64 if wide else np.int32) for a in (x, book))
    last, n = len(x) - 1, x.shape[1]

    def completed(d, entry, so_far):
        """The whole distance of one entry a row, of which dimensions up to d are in."""
        for e in range(d + 1, last + 1):
            so_far = so_far + (x[e] - book[e][entry]) ** 2
        return so_far

    # While many pairs are open, the mask lies over the whole block.
    partial, best = np.zeros((n, book.shape[1]), x.dtype), np.full(n, np.iinfo(x.dtype).max, x.dtype)
    for d in range(last + 1):
        step = x[d][:, None] - book[d]
        step *= step
        partial += step
        lead = partial.argmin(1)
        best = np.minimum(best, completed(d, lead, partial[np.arange(n), lead]))
        open_ = partial <= best[:, None]
        if np.count_nonzero(open_) * SPARSE < open_.size:
            break
    # Then only open pairs are kept, by row and entry.
    row, entry = np.divmod(np.flatnonzero(open_), book.shape[1])
    partial = partial[row, entry]
    for d in range(d + 1, last + 1):
        partial = partial + (x[d][row] - book[d][entry]) ** 2
        lead = _first_least(row, partial)
        best = np.minimum(best, completed(d, entry[lead], partial[lead]))
        kept = np.flatnonzero(partial <= best[row])
        row, entry, partial = row[kept], entry[kept], partial[kept]
    lead = _first_least(row, partial)
    return entry[lead], partial[lead].astype(np.int64)


def _first_least(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first least value of each row; every row is there, in order."""
    at = bounds(row)
    least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, at[:-1]), np.diff(at)))
    return least[bounds(row[least])[:-1]]


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors (n, dim) and codebooks (parts, entries, width) -> codes (n, parts) and the squared distances (n, parts)."""
    codes, far = (np.zeros((len(x), len(books)), np.int64) for _ in range(2))
    cut = x.reshape(len(x), len(books), -1)
    for p, book in enumerate(books):
        for i in range(0, len(x), STEP):
            codes[i : i + STEP, p], far[i : i + STEP, p] = nearest(cut[i : i + STEP, p], book)
    return codes, far


def integers(lists: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of vectors without nulls, all of length `dim`."""
    return np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(-1, dim)


def _finite(v):
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _fitting(v, parts: int):
    """Vectors that can be cut into parts and whose integers stay within LIMIT."""
    return (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: F.abs(x) < F.lit(LIMIT / SCALE))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks of the smallest ids (nulls last, then by vector): of the length that the first of them has. None without rows."""
    smallest = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    v = smallest(rows)
    if not len(v):
        return None
    dim = len(v[0])
    if len(set(v.value_lengths().to_pylist())) > 1:
        v = smallest(rows.where(F.size("v") == dim))
    return integers(v, dim).reshape(len(v), parts, -1).swapaxes(0, 1)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round over all rows; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches):
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            x = integers(b.column("v"), parts * width)
            codes, _ = assigned(x, books)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], x[:, p * width : p * width + width])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(total[p, e].ravel()))], ["part", "entry", "n", "sums"])

    mine = rows.where(F.size("v") == parts * width).select("v").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    whole = mine.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(width)])
    books = books.copy()
    for p, e, n, *total in whole.collect():  # parts x entries rows at most
        books[p, e] = [int(t) // n for t in total]
    return books


def trained(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of embeddings (vec_id, embedding); None if no vector can be coded."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where(_finite(F.col("v"))).where(_fitting(F.col("v"), parts))
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = refined(rows, books)
    return books


def digest(books: np.ndarray | None) -> str:
    """Lowercase hex of the SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray | None) -> DataFrame:
    """Adds code (two hex digits a part) and error (squared distances, summed) to the rows whose vector is finite; the vector stays.

    Rows with a null vector, or one that holds null or non-finite components, go. Vectors of another length than the codebooks',
    or with integers beyond LIMIT, have neither code nor error. Other columns stay; of `code` and `error` these win.
    """
    kept = [c for c in vectors.columns if c.lower() not in ("code", "error")]
    v, = fresh(vectors.columns, "v")
    rows = vectors.select(*[F.col(f"`{c}`") for c in kept]).where(_finite(F.col("embedding")))
    if books is None:
        return rows.select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    parts, _, width = books.shape
    rows = rows.withColumn(v, F.when(_fitting(F.col("embedding"), parts) & (F.size("embedding") == parts * width), F.col("embedding")))

    def run(batches):
        for b in batches:
            there = b.column(v).is_valid()
            codes, far = assigned(integers(b.column(v).filter(there), parts * width), books)
            text = codes.astype(np.uint8).tobytes().hex()
            row = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            code, error = np.full(b.num_rows, None), np.zeros(b.num_rows, np.int64)
            code[row], error[row] = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], far.sum(1)
            missing = np.ones(b.num_rows, bool)
            missing[row] = False
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=missing)], [*kept, "code", "error"])

    return rows.mapInArrow(run, rows.drop(v).schema.add("code", "string").add("error", "long"))


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds `approximate`, the vector that each code stands for (array<double>); null where there is no code."""

    def run(batches):
        for b in batches:
            there = b.column("code").is_valid()
            byte = np.frombuffer(bytes.fromhex("".join(b.column("code").filter(there).to_pylist())), np.uint8).reshape(-1, len(books))
            x = (books[np.arange(len(books)), byte] + 0.5) / SCALE
            size = np.cumsum(np.concatenate(([0], np.where(there.to_numpy(zero_copy_only=False), books.shape[0] * books.shape[2], 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(size), pa.array(x.ravel()), mask=pa.compute.invert(there))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "approximate"])

    return codes.mapInArrow(run, codes.select("*").schema.add("approximate", T.ArrayType(T.DoubleType())))


def with_sums(rows: DataFrame, by: str, of: str, name: str) -> DataFrame:
    """Adds the sum of `of` over all rows of equal `by`, nulls together. Sums of frequent values are broadcast, the others are joined."""
    sums = written(rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"), F.sum(of).alias(name)), "sums")
    least = (sums.agg(F.sum("__n")).first()[0] or 0) / HOT
    often = F.broadcast(sums.where(F.col("__n") >= least).select("__by", F.col(name).alias("__of"), F.lit(True).alias("__hot")))
    parted = rows.join(often, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    rare = sums.where(F.col("__n") < least).drop("__n")
    joined = parted.where("__hot is null").drop("__hot", "__of").join(rare, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    return parted.where("__hot").withColumnRenamed("__of", name).drop("__hot").select(*joined.columns).union(joined)


def compressed(vectors: DataFrame, *, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """embeddings (vec_id, embedding, label; other columns are ignored) -> vec_id, code, error, label_error, codebooks_sha256.

    A row for each row whose vector is not null and holds neither null nor non-finite components. Null ids come last among the
    smallest; repeated ids and rows are rows each. Vectors that no code fits (`encoded`) have null code and error, and count
    nothing in label_error; of several lengths the smallest id's is coded. Fewer than `entries` rows make smaller codebooks.
    An empty table gives none.
    """
    bounded_batches(vectors.sparkSession)
    vectors = vectors.select("vec_id", F.col("embedding"), F.col(label).alias("label"))
    books = trained(vectors, parts=parts, entries=entries, rounds=rounds)
    rows = written(encoded(vectors, books).select("vec_id", "label", "code", "error"), "codes")
    return with_sums(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir):
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same in DuckDB: three full assignments, and means between them."""
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT r, p, x, e, d FROM (SELECT v.r, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut v JOIN b{i} b ON b.p = v.p) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"
    mean = lambda i: f"m{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT p, e, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS m FROM a{i}, unnest(range(1, len(x) + 1)) t(j) GROUP BY p, e, j) GROUP BY p, e), b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)"
    steps = ", ".join(f"{near(i)}, {mean(i)}" for i in range(ROUNDS))
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (SELECT r, p, x[(p * (len(x) // {PARTS}) + 1):((p + 1) * (len(x) // {PARTS}))] AS x FROM v, unnest(range({PARTS})) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {ENTRIES}), {steps}, {near(ROUNDS)},
whole AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN whole USING (r), books
"""


SQL = _sql()
