"""A quantised multi-vector index: token centroids, residuals in a few bits, inverted lists, and exact MaxSim of what is left.

A document is a flat vector of `tokens` token vectors. Each token belongs to its nearest centroid; what the centroid leaves over
is cut into 2**bits equal steps a component. The index is a table of blocks of documents (split, shard), each with its
inverted lists one after the other: the tokens in order of centroid, their codes packed into bytes, and how far
each decoded token is from the true one.

Search: every query token probes the lists of the `probes` centroids with the greatest dot products. A document's estimate
takes for each query token the best decoded token met, or the first centroid that is not probed, whichever is more; the error
of what was met is at most the query token's length times the decoded token's distance. `slack` times that bound gives a low
and a high score; a document is scored exactly if its high score reaches the k-th best low score of the query. With
all lists probed and slack 1 nothing is lost; under that, recall is measured (`recall`).

Every task holds one block of queries and passes on what can still be among the k best, so the shuffle is bounded
by the margin about the k best, queries and tasks. Blocks of the index and of queries meet in the grid of the similarity join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.shards import bounded
from siltstone.operators.topk import QUERY_BYTES, Held, grid, packed, ranked, rescored
from siltstone.sources.sinks import staged

BITS, ROUNDS, SLACK, BLOCK = 4, 2, 0.25, 4096
#: Centroids at most; with 128 components they take 16 MB.
CENTROIDS = 16_384


@dataclass(frozen=True)
class Codec:
    """Centroids (n, width), the largest absolute residual component, and bits a component."""

    centroids: np.ndarray
    reach: float
    bits: int = BITS

    @property
    def step(self) -> float:
        return 2 * self.reach / (1 << self.bits)

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """Number of each token's nearest centroid; distances to nine places, ties to the lower number."""
        half = (self.centroids**2).sum(1) / 2
        return np.concatenate([np.round(x[i : i + 4096] @ self.centroids.T - half, 9).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def levels(self, x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.centroids[centroid] + self.reach) / self.step) if self.reach else np.zeros_like(x), 0, (1 << self.bits) - 1).astype(np.uint8)

    def decoded(self, levels: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        return self.centroids[centroid] + (-self.reach + (levels + 0.5) * self.step)

    def pack(self, levels: np.ndarray) -> bytes:
        """`bits` bits a component, the lowest first."""
        return np.packbits((levels.ravel()[:, None] >> np.arange(self.bits, dtype=np.uint8)) & 1, bitorder="little").tobytes()

    def unpack(self, code: bytes, n: int) -> np.ndarray:
        """n components."""
        each = np.unpackbits(np.frombuffer(code, np.uint8), bitorder="little")[: n * self.bits].reshape(n, self.bits)
        return (each << np.arange(self.bits, dtype=np.uint8)).sum(1, dtype=np.uint8)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def centroids_for(tokens: int) -> int:
    """A power of two near four times the square root of the number of tokens, CENTROIDS at most."""
    return min(CENTROIDS, 1 << max(0, round(np.log2(4 * max(tokens, 1) ** 0.5))))


def trained(documents: DataFrame, tokens: int, *, centroids: int | None = None, rounds: int = ROUNDS, bits: int = BITS) -> Codec:
    """The codec of documents (split, document_id, v). Centroids begin as the first tokens in order of document; each round is one pass
    in which a task adds up its tokens by centroid, so a row a task and centroid is shuffled, and only centroids reach the driver."""
    rows = documents.where("v is not null").select("document_id", "v")
    n = centroids or centroids_for(rows.count() * tokens)
    first = rows.orderBy("document_id", "v").limit(-(-n // tokens)).toArrow()
    if not first.num_rows:
        raise ValueError("no vectors to index")
    x = _matrix(first.column("v"))
    x = x.reshape(len(x) * tokens, -1)[:n]
    width = x.shape[1]
    for _ in range(rounds):
        now = Codec(x, 0.0, bits)

        def sums(batches, now=now):
            total, count = np.zeros_like(now.centroids), np.zeros(len(now.centroids), np.int64)
            for b in batches:
                t = _matrix(b.column("v")).reshape(-1, width)
                of = now.assigned(t)
                count += np.bincount(of, minlength=len(count))
                np.add.at(total, of, t)
            c = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(count[c]), pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * width), pa.array(total[c].ravel()))], ["c", "n", "s"])

        whole = rows.select("v").mapInArrow(sums, "c long, n long, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
        x = x.copy()
        for c, n_, *total in whole.collect():
            x[c] = np.round(np.array(total) / n_, 9)
    centre = Codec(x, 0.0, bits)

    def reach(batches):
        top = 0.0
        for b in batches:
            t = _matrix(b.column("v")).reshape(-1, width)
            top = max(top, float(np.abs(t - x[centre.assigned(t)]).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])

    return Codec(x, rows.select("v").mapInArrow(reach, "top double").agg(F.max("top")).first()[0], bits)


_LISTS = "split string, shard int, ids array<bigint>, token array<int>, centroid array<int>, far array<double>, code binary"


def built(documents: DataFrame, codec: Codec, tokens: int, *, block: int = BLOCK) -> DataFrame:
    """The index of documents (split, document_id, v): a row for each block of at most `block` documents of a split, in order of id.

    ids: the block's documents; token: place of the token in its document, `tokens` times that of the document besides, in
    order of centroid; rows without vector have no part.
    """
    dealt = bounded(documents.where("v is not null").select("split", "document_id", "v"), "document_id", block)
    rows = dealt.groupBy("split", "shard").agg(F.array_sort(F.collect_list(F.struct("document_id", "v"))).alias("rows"))
    rows = rows.select("split", "shard", F.transform("rows", lambda r: r["document_id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("v"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, v = b.column("ids")[r].values.to_numpy(), b.column("v")[r].values.to_numpy()
                x = v.reshape(len(ids) * tokens, -1)
                of = codec.assigned(x)
                order = np.argsort(of, kind="stable")
                x, of = x[order], of[order]
                levels = codec.levels(x, of)
                far = np.sqrt(((x - codec.decoded(levels, of)) ** 2).sum(1))
                one = lambda a, t: pa.array([a], pa.list_(t))
                yield pa.RecordBatch.from_arrays([b.column("split").slice(r, 1), b.column("shard").slice(r, 1), one(ids, pa.int64()), one(order.astype(np.int32), pa.int32()), one(of.astype(np.int32), pa.int32()), one(far, pa.float64()), pa.array([codec.pack(levels)])], ["split", "shard", "ids", "token", "centroid", "far", "code"])

    return rows.mapInArrow(run, _LISTS)


def write_index(index: DataFrame, codec: Codec, path: str) -> None:
    """Blocks under {path}/lists, by split; the codec under {path}/codec, a row a centroid."""
    spark = index.sparkSession
    index.write.mode("overwrite").partitionBy("split").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist(), codec.reach, codec.bits) for i, c in enumerate(codec.centroids)], "number int, centroid array<double>, reach double, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, Codec]:
    rows = spark.read.parquet(f"{path}/codec").orderBy("number").collect()
    lists = spark.read.schema(_LISTS).parquet(f"{path}/lists")
    return lists, Codec(np.array([r.centroid for r in rows]), rows[0].reach, rows[0].bits)


def estimates(codec: Codec, q: np.ndarray, block: dict, tokens: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, bound of its error) of each query (flat vectors) with each document of a block. Lists that no query probes are not read."""
    asked = q.reshape(len(q) * tokens, -1)
    near = asked @ codec.centroids.T
    n = len(codec.centroids)
    probed, missed = np.ones(near.shape, bool), np.full(len(asked), -np.inf)
    if probes < n:
        order = np.argsort(-np.round(near, 9), 1, kind="stable")
        probed[:] = False
        np.put_along_axis(probed, order[:, :probes], True, 1)
        missed = np.take_along_axis(near, order[:, probes : probes + 1], 1)[:, 0]
    met = np.repeat(missed[:, None], len(block["token"]), 1)
    cut = np.searchsorted(block["centroid"], np.arange(n + 1))
    for c in np.unique(block["centroid"]).tolist():
        rows = np.flatnonzero(probed[:, c])
        if len(rows):
            at = slice(cut[c], cut[c + 1])
            met[rows, at] = np.maximum(met[rows, at], asked[rows] @ block["x"][at].T)
    place = np.empty(len(block["token"]), np.int64)
    place[block["token"]] = np.arange(len(place))
    best = met[:, place].reshape(len(q), tokens, -1, tokens).max(3).sum(1)
    length = np.sqrt((asked**2).sum(1)).reshape(len(q), tokens).sum(1)
    return best, length[:, None] * block["far"][place].reshape(-1, tokens).max(1)


class Left:
    """What may still be among the k best of n queries: documents whose high score reaches the k-th best low score so far."""

    def __init__(self, n: int, k: int):
        self.low, self.rows, self.size, self.pruned = Held(n, k), [], 0, 0

    def add(self, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> None:
        self.low.add(low, doc)
        self.low.best()
        row, at = np.nonzero(np.round(high, 9) >= np.round(self.low.edge[:, None], 9))
        self.rows.append((row, doc[at], low[row, at], high[row, at]))
        self.size += len(row)
        if self.size > 2 * self.pruned + (1 << 16):
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """(query, document, low, high)."""
        row, doc, low, high = (np.concatenate(c) for c in zip(*self.rows))
        there = np.round(high, 9) >= np.round(self.low.edge[row], 9)
        self.rows = [(row[there], doc[there], low[there], high[there])]
        self.size = self.pruned = int(there.sum())
        return self.rows[0]


#: Queries whose estimates are made together; their tokens meet all tokens of a block.
STEP = 32


def candidates(queries: DataFrame, index: DataFrame, codec: Codec, k: int, tokens: int, probes: int, *, slack: float = SLACK, within_split: bool = True, most: int = QUERY_BYTES) -> DataFrame:
    """queries (split, query_id, v) -> split, query_id, document_id: all whose high score reaches the k-th best low score of the query."""
    asked = packed(queries.select("split", "query_id", "v").where("v is not null"), "query_id", "q")
    blocks = index.select(F.col("split").alias("ds"), F.col("ids").alias("di"), F.col("far").alias("dv"), "token", "centroid", "code")
    pairs = grid(asked, blocks, within_split, most).select("qs", "qi", "qv", "di", "dv", "token", "centroid", "code")
    width = codec.centroids.shape[1]

    def run(batches):
        last, ids, left = None, None, []

        def done():
            for i, part in enumerate(left):
                row, doc, low, high = part.best()
                yield pa.RecordBatch.from_arrays([pa.array([last[0]] * len(row), pa.string()), pa.array(ids[row + i * STEP]), pa.array(doc), pa.array(low), pa.array(high)], ["split", "query_id", "document_id", "low", "high"])

        for b in batches:
            for r in range(b.num_rows):
                cell = lambda c: b.column(c)[r].values.to_numpy()  # noqa: B023, E731
                name = (b.column("qs")[r].as_py(), cell("qi").tobytes())
                if name != last:
                    yield from done()
                    last, ids = name, cell("qi").copy()
                    left = [Left(min(STEP, len(ids) - i), k) for i in range(0, len(ids), STEP)]
                q, doc = cell("qv").reshape(len(ids), -1), cell("di").copy()
                block = {"token": cell("token"), "centroid": cell("centroid"), "far": cell("dv")}
                block["x"] = codec.decoded(codec.unpack(b.column("code")[r].as_py(), len(block["token"]) * width).reshape(-1, width), block["centroid"])
                for i, part in enumerate(left):
                    best, error = estimates(codec, q[i * STEP : i * STEP + STEP], block, tokens, probes)
                    part.add(best - slack * error, best + slack * error, doc)
        yield from done()

    found = pairs.mapInArrow(run, "split string, query_id bigint, document_id bigint, low double, high double")
    nth = F.row_number().over(W.partitionBy("split", "query_id").orderBy(F.col("low").desc()))
    edge = F.max(F.when(F.col("nth") == k, F.round("low", 9))).over(W.partitionBy("split", "query_id"))
    return found.withColumn("nth", nth).withColumn("edge", edge).where(F.col("edge").isNull() | (F.round("high", 9) >= F.col("edge"))).select("split", "query_id", "document_id")


def indexed_topk(queries: DataFrame, documents: DataFrame, index: DataFrame, codec: Codec, k: int, tokens: int, probes: int, *, slack: float = SLACK, within_split: bool = True, most: int = QUERY_BYTES) -> DataFrame:
    """split, query_id, document_id, score, rank <= k, scored: the k best by exact MaxSim of those that the index leaves, and how many those were.

    split is the query's; without `within_split` ids are those of one space for all splits.
    """
    left = staged(candidates(queries, index, codec, k, tokens, probes, slack=slack, within_split=within_split, most=most), "left")
    q = queries.select("split", "query_id", F.col("v").alias("qv"))
    d = documents.select(*(["split"] if within_split else []), "document_id", F.col("v").alias("dv"))
    rows = rescored(left.join(q, ["split", "query_id"]).join(d, ["split", "document_id"] if within_split else "document_id"), "qv", "dv", tokens, "score")
    scored = F.count("*").over(W.partitionBy("split", "query_id"))
    return ranked(rows.withColumn("scored", scored), k).select("split", "query_id", "document_id", "score", "rank", "scored")


def recall(found: DataFrame, exact: DataFrame, corpus: DataFrame) -> DataFrame:
    """A row a split: queries, recall (share of the exact top k that was found, over all queries), scored_share (documents scored exactly of all of the split's)."""
    key = ["split", "query_id", "document_id"]
    hit = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    met = hit.groupBy("split").agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
    work = found.select("split", "query_id", "scored").distinct().groupBy("split").agg(F.avg("scored").alias("scored"))
    size = corpus.groupBy("split").agg(F.count("*").alias("documents"))
    return met.join(work, "split").join(size, "split").select("split", "queries", "recall", (F.col("scored") / F.col("documents")).alias("scored_share"))
