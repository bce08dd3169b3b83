"""Ranks, merges of shard results, and the similarity join with partial top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import bounded_batches

QUERY = ("split", "query_id")
#: Bytes of query vectors that go to every task.
QUERY_BYTES = 64_000_000
#: Bytes that a held document takes, and of all that a task holds at a time (what joins them and their sort take some times as much).
HELD_BYTES, HELD = 24, 4_000_000
#: Rows of documents to a block, scores of one product, and rows of a split's grid that spread its query blocks.
DOC_BLOCK, PRODUCT, SPREAD = 1000, 1 << 20, 16


def best_first(score: Column | str = "score", doc: str = "document_id") -> list[Column]:
    """The one total order: score (to 9 places) downwards, then id."""
    score = F.col(score) if isinstance(score, str) else score
    return [F.round(score, 9).desc(), F.col(doc).asc()]


def ranked(df: DataFrame, k: int | None = None, by=QUERY, order=None, name: str = "rank", skip: int = 0) -> DataFrame:
    """Rank from 1 within `by`; with k only ranks skip+1 .. skip+k, renumbered from 1."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*(order or best_first()))))
    if k is None:
        return out
    out = out.where(F.col(name) <= skip + k)
    return out.where(F.col(name) > skip).withColumn(name, F.col(name) - skip) if skip else out


def valid(df: DataFrame, doc: str = "document_id", score: str = "score") -> DataFrame:
    """Rows with an id that is no padding and a finite score."""
    s = F.col(score)
    return df.where((F.col(doc) >= 0) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))))


def merged(shards: DataFrame, k: int) -> DataFrame:
    """Top k over all shards; a document that stands in two shards stands twice."""
    return ranked(shards, k, order=[*best_first(), F.col("shard")])


def merged_best(shards: DataFrame, k: int) -> DataFrame:
    """Top k over all shards' valid rows, each document once with its best score."""
    best = valid(shards).groupBy("split", "query_id", "document_id").agg(F.max("score").alias("score"))
    return ranked(best, k)


def exactly(df: DataFrame, n: int, by=QUERY) -> DataFrame:
    """Groups of n rows at least; the others are dropped whole."""
    return df.withColumn("__n", F.count("*").over(W.partitionBy(*by))).where(F.col("__n") >= n).drop("__n")


def rescored(rows: DataFrame, q: str, d: str, tokens: int, name: str) -> DataFrame:
    """Pointwise MaxSim of two flat vectors (`tokens` token vectors each) in Arrow batches; replaces q and d by `name`. Null vectors: null."""
    return rescored_by(rows, q, d, {name: tokens})


def rescored_by(rows: DataFrame, q: str, d: str, kinds: dict[str, int]) -> DataFrame:
    """Several scores of the same two vectors in one pass: a column for each name of `kinds`, with its number of token vectors."""
    kept = [f for f in rows.schema if f.name not in (q, d)]
    schema = T.StructType([*kept, *[T.StructField(name, T.DoubleType()) for name in kinds]])

    def run(batches):
        for b in batches:
            there = pc.and_(b.column(q).is_valid(), b.column(d).is_valid())
            mask, part, scores = there.to_numpy(zero_copy_only=False), b.filter(there), []
            flat = [part.column(c).flatten().to_numpy().astype(np.float64) for c in (q, d)]
            for tokens in kinds.values():
                out = np.full(b.num_rows, np.nan)
                if part.num_rows:
                    out[mask] = _pointwise(*(v.reshape(part.num_rows, -1) for v in flat), tokens)
                scores.append(pa.array(out, mask=~mask))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *scores], [*[f.name for f in kept], *kinds])

    return rows.mapInArrow(run, schema)


def _pointwise(x: np.ndarray, y: np.ndarray, tokens: int) -> np.ndarray:
    """MaxSim of each row of x with the same row of y."""
    x, y = (v.reshape(len(v), tokens, -1) for v in (x, y))
    return np.concatenate([np.einsum("naw,nbw->nab", x[i : i + 4096], y[i : i + 4096], optimize=True).max(2).sum(1) for i in range(0, len(x), 4096)])


def pair_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame, tokens: int, name: str, most: int = QUERY_BYTES) -> DataFrame:
    """pairs (split, query_id, document_id), for many queries a document -> the same and their MaxSim as `name`; pairs without both vectors go.

    A pair moves as two ids, a document's vector once: pairs are gathered by document, and up to `most` bytes of query vectors go to
    every task as a broadcast variable. With more, each pair is joined with both vectors.
    """
    bounded_batches(pairs.sparkSession)
    asked = queries.select("split", "query_id", "v").where("v is not null")
    d = docs.select("split", "document_id", F.col("v").alias("dv")).where("dv is not null")
    if asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8 > most:
        rows = pairs.select("split", "query_id", "document_id").join(asked.withColumnRenamed("v", "qv"), list(QUERY)).join(d, ["split", "document_id"])
        return rescored(rows, "qv", "dv", tokens, name).select("split", "query_id", "document_id", name)
    held, sides = asked.toArrow().sort_by([("split", "ascending"), ("query_id", "ascending")]), {}
    names = np.array(held.column("split").to_pylist(), object)
    for key in set(names):
        mine = held.take(pa.array(np.flatnonzero(names == key)))
        sides[key] = (mine.column("query_id").to_numpy(), _dense(mine.column("v").combine_chunks()))
    sides = pairs.sparkSession.sparkContext.broadcast(sides)

    def run(batches):
        for b in batches:
            splits = np.array(b.column("split").to_pylist(), object)
            for key in set(splits) & set(sides.value):
                ids, q = sides.value[key]
                part = b.take(pa.array(np.flatnonzero(splits == key)))
                y, document, sizes = _dense(part.column("dv")), part.column("document_id").to_numpy(), pc.list_value_length(part.column("asked")).to_numpy()
                query, owner = part.column("asked").flatten().to_numpy(), np.repeat(np.arange(part.num_rows), sizes)
                at = np.minimum(np.searchsorted(ids, query), len(ids) - 1)
                there = ids[at] == query
                query, owner, at = query[there], owner[there], at[there]
                for i in range(0, len(query), 1 << 14):
                    o = owner[i : i + (1 << 14)]
                    score = _pointwise(q[at[i : i + (1 << 14)]], y[o], tokens)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(o), pa.string()), pa.array(query[i : i + (1 << 14)]), pa.array(document[o]), pa.array(score)], ["split", "query_id", "document_id", name])

    gathered = pairs.groupBy("split", "document_id").agg(F.collect_list("query_id").alias("asked")).join(d, ["split", "document_id"])
    return gathered.mapInArrow(run, f"split string, query_id bigint, document_id bigint, `{name}` double")


class Held:
    """The k best documents so far of each of n queries, over all blocks that a task meets; the order is that of `best_first`.

    A block's scores join only where they reach a query's k-th best so far; what has joined is sorted when it outgrows what is
    held by as much again and HELD bytes, so a block costs little more than its product once the lists are full.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.edge = n, k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.held = 0

    def add(self, score: np.ndarray, doc: np.ndarray, first: int = 0) -> None:
        """Scores of the queries from `first` on against the documents `doc`."""
        edge = self.edge[first : first + len(score), None]
        if len(doc) > self.k:
            edge = np.maximum(edge, np.partition(score, len(doc) - self.k, 1)[:, len(doc) - self.k, None])
        row, at = np.nonzero(score >= edge - 2e-9)
        self.parts.append((row + first, doc[at], score[row, at]))
        self.size += len(row)
        if self.size > 2 * self.held + HELD // HELD_BYTES:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the k best of each query."""
        row, doc, score = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((doc, -np.round(score, 9), row))
        begin = np.searchsorted(row[order], np.arange(self.n + 1))
        order = order[np.arange(len(row)) - begin[row[order]] < self.k]
        row, doc, score = row[order], doc[order], score[order]
        sizes = np.minimum(np.diff(begin), self.k)
        full = sizes == self.k
        self.edge[full] = score[np.cumsum(sizes)[full] - 1]
        self.parts, self.size, self.held = [(row, doc, score)], len(row), len(row)
        return row, doc, score

    def batch(self, ids: np.ndarray, names) -> pa.RecordBatch:
        row, doc, score = self.best()
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in row], pa.string()), pa.array(ids[row]), pa.array(doc), pa.array(score)], ["split", "query_id", "document_id", "score"])


def _maxsims(q: np.ndarray, d: np.ndarray, tokens: int) -> np.ndarray:
    """MaxSim of every query with every document; rows of flat vectors."""
    width = d.shape[1] // tokens
    return (q.reshape(-1, width) @ d.reshape(-1, width).T).reshape(len(q), tokens, len(d), tokens).max(3).sum(1)


def _scored(q: np.ndarray, d: np.ndarray, tokens: int):
    """(first query, scores) of runs of queries against all of `d`; a product has PRODUCT cells at most, or those of one query."""
    step = max(1, PRODUCT // max(1, len(d) * tokens * tokens))
    for i in range(0, len(q), step):
        yield i, _maxsims(q[i : i + step], d, tokens)


def _dense(lists) -> np.ndarray:
    flat = lists.flatten().to_numpy()
    return flat.reshape(len(lists), -1).astype(np.float64)


_SCORES = "split string, query_id bigint, document_id bigint, score double"


def similarity_topk(queries: DataFrame, docs: DataFrame, k: int, tokens: int = 1, within_split: bool = True, most: int = QUERY_BYTES) -> DataFrame:
    """queries (split, query_id, v), documents (split, document_id, v) -> split, query_id, document_id, score, rank <= k.

    v: flat vectors of `tokens` token vectors; the score is MaxSim, for one token the dot product, in double precision.
    Rows without vector have no part.
    """
    return ranked(partial_topk(queries, docs, k, tokens, within_split, most), k)


def partial_topk(queries: DataFrame, docs: DataFrame, k: int, tokens: int = 1, within_split: bool = True, most: int = QUERY_BYTES) -> DataFrame:
    """The k best documents of each query in each task: split, query_id, document_id, score.

    Query blocks meet document batches in one matrix product each; a task merges the products into the k best a query so far
    and passes them on once, so what is shuffled is bounded by k x queries x tasks, not by batches or pairs. Up to `most`
    bytes of query vectors (their size is counted first), whose k best take up to HELD bytes, go to every task as a broadcast
    variable; more are packed into blocks, which meet packed document blocks in a distributed product of blocks.
    """
    bounded_batches(queries.sparkSession)
    asked, rows = queries.select("split", "query_id", "v").where("v is not null"), docs.select("split", "document_id", "v").where("v is not null")
    size, n = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)), F.count("*")).first()
    if size * 8 > most or n * k * HELD_BYTES > HELD:
        return _packed_topk(asked, rows, k, tokens, within_split, most)
    held = asked.toArrow()
    sides = {}
    names = np.array(held.column("split").to_pylist(), object)
    for key in sorted(set(names), key=str) if within_split else [None]:
        of = np.flatnonzero(names == key) if within_split else np.arange(len(names))
        if len(of):
            mine = held.take(pa.array(of))
            sides[key] = (_dense(mine.column("v").combine_chunks()), mine.column("query_id").to_numpy(), names[of])
    sides = queries.sparkSession.sparkContext.broadcast(sides)

    def run(batches):
        best = {key: Held(len(ids), k) for key, (_, ids, _) in sides.value.items()}
        for b in batches:
            splits = np.array(b.column("split").to_pylist(), object)
            for key, (q, _, _) in sides.value.items():
                at = np.flatnonzero(splits == key) if within_split else np.arange(b.num_rows)
                if len(at):
                    part = b.take(pa.array(at))
                    d, doc = _dense(part.column("v")), part.column("document_id").to_numpy()
                    for i, score in _scored(q, d, tokens):
                        best[key].add(score, doc, i)
        for key, (_, ids, own) in sides.value.items():
            yield best[key].batch(ids, own)

    return rows.mapInArrow(run, _SCORES)


def packed(df: DataFrame, id_: str, prefix: str, rows: int = 2000) -> DataFrame:
    """(split, id, v) -> one row for up to `rows` rows of a split: {prefix}s, {prefix}i (ids), {prefix}v (vectors, one after the other)."""

    def run(batches):
        for b in batches:
            splits = np.array(b.column("split").to_pylist(), object)
            for key in sorted(set(splits), key=str):
                at = np.flatnonzero(splits == key)
                for i in range(0, len(at), rows):
                    part = b.take(pa.array(at[i : i + rows]))
                    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), one(part.column(id_)), one(pa.array(_dense(part.column("v")).ravel()))], [f"{prefix}s", f"{prefix}i", f"{prefix}v"])

    return df.mapInArrow(run, f"{prefix}s string, {prefix}i array<bigint>, {prefix}v array<double>")


def grid(q: DataFrame, d: DataFrame, within_split: bool, most: int, spread: int = 1) -> DataFrame:
    """Every pair of a query block (qs, qi, qv, ...) and a document block (ds, di, dv, ...), of one split each if so asked; a row a pair.

    Blocks are dealt to a grid for each split, with a row for every `most` bytes of its queries and a column for every
    `most` bytes of its documents: a query block goes to one row and all columns, a document block to one column and all
    rows, and each pair meets in one cell. So a large split is spread over many tasks; documents are copied once for
    each row of their own split's grid. The pairs of one query block come one after the other.
    spread: so many rows at least, if each of them has two query blocks.
    """
    group = lambda side: F.col(f"{side}s") if within_split else F.lit("")

    def lines(df: DataFrame, side: str, name: str, least: int = 1) -> DataFrame:
        spread = F.least(F.lit(least), F.ceil(F.count("*") / 2))
        return df.groupBy(group(side).alias(f"{name}_g")).agg(F.greatest(F.ceil(F.sum(F.size(f"{side}v")) * 8 / F.lit(most)), spread).cast("int").alias(name))

    def dealt(df: DataFrame, side: str, own: str, every: str) -> DataFrame:
        at = df.join(F.broadcast(sizes), group(side).eqNullSafe(F.col("g")))
        place = F.pmod(F.xxhash64(f"{side}i"), F.col(own)).cast("int")
        return at.select(*df.columns, F.col("g").alias(f"{side}g"), place.alias(f"{side}{own}"), F.explode(F.sequence(F.lit(0), F.col(every) - 1)).alias(f"{side}{every}"))

    # A row a split: small enough to broadcast.
    sizes = lines(q, "q", "row", spread).join(lines(d, "d", "col"), F.col("row_g").eqNullSafe(F.col("col_g"))).select(F.col("row_g").alias("g"), "row", "col")
    q, d = dealt(q, "q", "row", "col"), dealt(d, "d", "col", "row").hint("merge")
    return q.join(d, F.col("qg").eqNullSafe(F.col("dg")) & (F.col("qrow") == F.col("drow")) & (F.col("qcol") == F.col("dcol")))


def _packed_topk(queries: DataFrame, docs: DataFrame, k: int, tokens: int, within_split: bool, most: int) -> DataFrame:
    """Every pair of blocks is one product; the k best are held while the query block stays the same, so a block has as many queries as HELD has room for."""
    block = min(2000, max(1, HELD // (k * HELD_BYTES)))
    pairs = grid(packed(queries, "query_id", "q", block), packed(docs, "document_id", "d", DOC_BLOCK), within_split, most, SPREAD)

    def run(batches):
        last, held = None, None
        for b in batches:
            for r in range(b.num_rows):
                cell = lambda c: b.column(c)[r].values.to_numpy()  # noqa: B023, E731
                qi, di = cell("qi"), cell("di")
                name = (b.column("qs")[r].as_py(), qi.tobytes())
                if name != last:
                    if held:
                        yield held.batch(ids, [last[0]] * len(ids))  # noqa: F821
                    last, held, ids = name, Held(len(qi), k), qi.copy()
                q, d = cell("qv").reshape(len(qi), -1), cell("dv").reshape(len(di), -1)
                for i, score in _scored(q, d, tokens):
                    held.add(score, di, i)
        if held:
            yield held.batch(ids, [last[0]] * len(ids))

    return pairs.select("qs", "qi", "qv", "di", "dv").mapInArrow(run, _SCORES)
