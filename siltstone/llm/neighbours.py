"""Approximate nearest neighbours by cross-polytope hashing.

Equal vectors are one node, with the k + 1 smallest ids. A hash function rotates unit vectors pseudo-randomly (three rounds of
random signs and a fast Hadamard transform) and takes the nearest signed axis. A table's bucket is made of as many
functions as leave about TARGET nodes a bucket (`depth`); there are TABLES tables.

Multiprobe: a query goes to the buckets whose axes lie nearest to it: of all combinations of signed axes those with the least
summed loss (best axis' coordinate less the axis'). How many is fitted: SAMPLE queries, in order of a hash, are compared with all
nodes by brute force, and the number of probes is the smallest that reaches the share GOAL of their true neighbours. Other
SAMPLE queries check it: while their recall is under LEAST_RECALL, the number doubles, at most to all buckets, which is an
exact search. Where neighbours are hardly nearer than others, that is what it takes.

Nodes and queries meet in their buckets: matrix products propose, and the k + 1 best of each query are scored anew in double
precision, on the original vectors. A bucket with many nodes or queries is cut into blocks that meet in a grid, so no task holds
more than two blocks. What several tables find is told apart by the nodes' names (two 64-bit hashes).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.arrowops import bounds, runs
from siltstone.llm.common import bounded_batches, table, written

NEAREST, EVERY, TABLES, TARGET, BLOCK, SEED = 5, 50, 4, 4096, 4096, 7
SAMPLE, GOAL, LEAST_RECALL = 200, 0.99, 0.95
#: Functions of a table at most: over 10**12 vectors of 64 components.
DEEPEST = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two; keeps lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]), 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def axes(x: np.ndarray, table: int, depth: int, seed: int = SEED) -> list[np.ndarray]:
    """Unit vectors in each of the table's rotations, with their negatives: column a is the product with the signed axis a."""
    n, dim = x.shape
    padded = np.zeros((n, 1 << max(dim - 1, 0).bit_length()))
    padded[:, :dim] = x
    out = []
    for f in range(depth):
        signs = np.random.default_rng((seed, dim, table, f)).choice([-1.0, 1.0], (3, padded.shape[1]))
        y = padded
        for s in signs:
            y = hadamard(y * s)
        out.append(np.concatenate((y, -y), 1))
    return out


def buckets(x: np.ndarray, table: int, depth: int) -> np.ndarray:
    """The bucket of each vector: the numbers of its nearest signed axes, one function after the other."""
    code = np.zeros(len(x), np.int64)
    for y in axes(x, table, depth):
        code = code * y.shape[1] + y.argmax(1)
    return code


def probes(x: np.ndarray, table: int, depth: int, n: int) -> np.ndarray:
    """The n buckets (all, if fewer) that each query probes, nearest first: by loss over all functions, ties to the lower number."""
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for y in axes(x, table, depth):
        own = y.max(1, keepdims=True) - y
        order = np.argsort(own, 1, kind="stable")[:, :n]
        own = np.take_along_axis(own, order, 1)
        # Of two ascending lists, the sum of the places i and j has (i + 1)(j + 1) - 1 sums before it at least.
        i, j = np.nonzero(np.outer(np.arange(1, loss.shape[1] + 1), np.arange(1, own.shape[1] + 1)) <= n)
        both, codes = loss[:, i] + own[:, j], code[:, i] * y.shape[1] + order[:, j]
        first = np.argsort(both, 1, kind="stable")[:, :n]
        loss, code = np.take_along_axis(both, first, 1), np.take_along_axis(codes, first, 1)
    return code


def places(q: np.ndarray, x: np.ndarray, table: int, depth: int) -> np.ndarray:
    """How many buckets each query probes before that of its neighbour: those of less loss."""
    out = np.zeros(len(q), np.int64)
    asked, met = axes(q, table, depth), axes(x, table, depth)
    own = [a.max(1, keepdims=True) - a for a in asked]
    mine = sum(o[np.arange(len(q)), m.argmax(1)] for o, m in zip(own, met))
    half = (depth + 1) // 2
    for r in range(len(q)):
        left, right = np.zeros(1), np.zeros(1)
        for o in own[:half]:
            left = np.add.outer(left, o[r]).ravel()
        for o in own[half:]:
            right = np.add.outer(right, o[r]).ravel()
        right.sort()
        out[r] = np.searchsorted(right, mine[r] - left - 1e-12, "left").sum()
    return out


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two matrices, in slices; large or tiny components are scaled by powers of two, which changes no digit."""
    even = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    out = np.empty(len(a))
    for i in range(0, len(a), 20_000):
        x, y = even(a[i : i + 20_000]), even(b[i : i + 20_000])
        out[i : i + 20_000] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return out


def best(q: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine): the k nearest rows of each query, ties to the smaller `first`. A product proposes, with a margin for its rounding."""
    out, uq, ux = [], unit(q), unit(x)
    for i in range(0, len(q), 64):
        s = uq[i : i + 64] @ ux.T
        edge = np.partition(s, len(x) - k, 1)[:, len(x) - k, None] if len(x) > k else -np.inf
        a, b = np.nonzero(s >= edge - 1e-9)
        score = cosines(q[a + i], x[b])
        order = np.lexsort((first[b], -score, a))
        at = bounds(a[order])
        rank = np.arange(len(a)) - np.repeat(at[:-1], np.diff(at))
        kept = order[rank < k]
        out.append((a[kept] + i, b[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _by_dim(b: pa.RecordBatch):
    """(dimension, rows) of a batch with a column dim."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, pa.array(np.flatnonzero(dims == d))


#: An id for ties: rows without id come last.
_NO_ID = np.iinfo(np.int64).max


def _first_ids(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return pa.compute.fill_null(pa.compute.list_element(lists, 0), _NO_ID).to_numpy(zero_copy_only=False)


def true_neighbours(asked: pa.Table, nodes: DataFrame, k: int) -> pa.Table:
    """a, b, v, x: of each asked vector (a, b, dim, v) the k nearest other nodes, by brute force; a task keeps k a query over all its batches."""
    sides = {d: asked.filter(pa.compute.equal(asked.column("dim"), d)) for d in set(asked.column("dim").to_pylist())}

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for d, rows in _by_dim(batch):
                if d not in sides:
                    continue
                mine = sides[d]
                part = batch.take(rows)
                q, x = matrix(mine.column("v"), d), matrix(part.column("v"), d)
                name = np.stack([part.column(c).to_numpy() for c in "ab"], 1)
                a, r, s = best(q, x, name[:, 0], k + 1)
                own = np.stack([mine.column(c).to_numpy() for c in "ab"], 1)
                other = (own[a] != name[r]).any(1)
                new = (a[other], name[r[other]], s[other], x[r[other]])
                a, name, s, x = (np.concatenate(c) for c in zip(held[d], new)) if d in held else new
                order = np.lexsort((name[:, 0], -s, a))
                at = bounds(a[order])
                kept = order[np.arange(len(a)) - np.repeat(at[:-1], np.diff(at)) < k]
                held[d] = (a[kept], name[kept], s[kept], x[kept])
        for d, (a, name, s, x) in held.items():
            if len(a):
                own = sides[d].take(pa.array(a))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("a").combine_chunks(), own.column("b").combine_chunks(), pa.array(name[:, 0]), pa.array(s), own.column("v").combine_chunks().cast(pa.list_(pa.float64())), lists], ["a", "b", "m", "s", "v", "x"])

    rank = F.row_number().over(W.partitionBy("a", "b").orderBy(F.col("s").desc(), "m"))
    found = nodes.mapInArrow(run, "a long, b long, m long, s double, v array<double>, x array<double>")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "v", "x").toArrow()


def fitted_probes(asked: DataFrame, nodes: DataFrame, k: int, depth: int, *, tables: int = TABLES, sample: int = SAMPLE, goal: float = GOAL, least: float = LEAST_RECALL) -> tuple[int, float]:
    """Probes a table, and the recall they reach on the queries that check it. A bounded sample of queries comes to the driver, with their true neighbours."""
    some = asked.orderBy(F.xxhash64("a"), "a", "b").limit(2 * sample).select("a", "b", "dim", "v").toArrow()
    truth = true_neighbours(some, nodes, k)
    order = {n: i for i, n in enumerate(zip(some.column("a").to_pylist(), some.column("b").to_pylist()))}
    number = np.array([order[n] for n in zip(truth.column("a").to_pylist(), truth.column("b").to_pylist())], np.int64)
    reach = np.full(len(number), np.iinfo(np.int64).max)
    sizes = truth.column("v").combine_chunks().value_lengths().to_numpy() if truth.num_rows else np.zeros(0, np.int64)
    every = 1
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        q, x = (unit(matrix(truth.column(c).take(pa.array(rows)), d)) for c in "vx")
        for t in range(tables):
            reach[rows] = np.minimum(reach[rows], places(q, x, t, depth) + 1)
        every = max(every, (2 << max(d - 1, 0).bit_length()) ** depth)
    fit, check = np.sort(reach[number < sample]), reach[number >= sample]
    if not len(fit):
        return 1, 1.0
    check = check if len(check) else fit
    n = int(fit[math.ceil(goal * len(fit)) - 1])
    while (check <= n).mean() < least and n < every:
        n *= 2
    return min(n, every), float((check <= n).mean())


def _dealt(rows: DataFrame, tables: int, depth: int, probed: int | None) -> DataFrame:
    """Each row once for each of its buckets: of each table its own, or those it probes."""
    names = [f.name for f in rows.schema]

    def run(batches):
        for b in batches:
            for d, at in _by_dim(b):
                part = b.take(at)
                x = unit(matrix(part.column("v"), d))
                for t in range(tables):
                    for i in range(0, len(x), 1024):
                        code = buckets(x[i : i + 1024], t, depth)[:, None] if probed is None else probes(x[i : i + 1024], t, depth, probed)
                        own = part.slice(i, len(code)).take(pa.array(np.repeat(np.arange(len(code)), code.shape[1])))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(code.size, t, np.int32)), pa.array(code.ravel())], [*names, "t", "code"])

    return rows.mapInArrow(run, rows.select("*").schema.add("t", "integer").add("code", "long"))


def _blocked(rows: DataFrame, large: DataFrame, side: str, block: int) -> DataFrame:
    """Adds lo, hi: the cells of its bucket's grid in which a row stands; buckets that are not large have one cell."""
    on = (F.col("dim") == F.col("large_dim")) & (F.col("t") == F.col("large_t")) & (F.col("code") == F.col("large_code"))
    own, other = ("lo", "hi") if side == "n" else ("hi", "lo")
    cells = lambda c: F.coalesce(c, F.lit(1))
    x = rows.join(large, on, "left").withColumn(own, F.pmod(F.xxhash64("a", "b"), cells(F.col(own + "_cells"))).cast("int"))
    return x.withColumn(other, F.explode(F.sequence(F.lit(0), cells(F.col(other + "_cells")) - 1))).drop("large_dim", "large_t", "large_code", "lo_cells", "hi_cells")


def candidates(asked: DataFrame, nodes: DataFrame, k: int, depth: int, probed: int, *, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """asked (a, b, dim, v), nodes (a, b, dim, v, ids) -> qa, qb, a, b, ids, score: of each cell where they meet the k best nodes of each query."""
    count = lambda df, p: _dealt(df.select("a", "b", "dim", "v"), tables, depth, p).groupBy("dim", "t", "code").agg(F.count("*").alias("n"))
    sizes = count(nodes, None).select("*", F.lit(0).alias("q")).union(count(asked, probed).select("dim", "t", "code", F.lit(0).alias("n"), F.col("n").alias("q")))
    cells = lambda c: F.greatest(F.ceil(F.sum(c) / F.lit(block)), F.lit(1)).cast("int")
    large = sizes.groupBy(F.col("dim").alias("large_dim"), F.col("t").alias("large_t"), F.col("code").alias("large_code")).agg(cells("n").alias("lo_cells"), cells("q").alias("hi_cells"))
    # Written, so that its size is known: a small table of large buckets is broadcast by Spark, a large one is joined by shuffles.
    large = written(large.where("lo_cells > 1 or hi_cells > 1"), "large")
    key = ["dim", "t", "code", "lo", "hi"]
    rows = _blocked(_dealt(nodes.select("a", "b", "dim", "v", "ids"), tables, depth, None), large, "n", block).select(*key, F.lit(0).alias("side"), "a", "b", "ids", "v")
    queries = _blocked(_dealt(asked.select("a", "b", "dim", "v"), tables, depth, probed), large, "q", block).select(*key, F.lit(1).alias("side"), "a", "b", F.lit(None).cast(nodes.schema["ids"].dataType).alias("ids"), "v")
    together = rows.union(queries).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches):
        for whole in runs(batches, key):
            at = bounds(*[whole.column(c).to_numpy() for c in key])
            asks = whole.column("side").to_numpy()
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                cut = i + int(np.searchsorted(asks[i:j], 1))
                if i < cut < j:
                    part, d = whole.slice(i, j - i), whole.column("dim")[i].as_py()
                    v = matrix(part.column("v"), d)
                    q, r, s = best(v[cut - i :], v[: cut - i], _first_ids(part.column("ids"))[: cut - i], k)
                    asking, met = part.take(pa.array(q + (cut - i))), part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([asking.column("a").combine_chunks(), asking.column("b").combine_chunks(), *(met.column(c).combine_chunks() for c in ("a", "b", "ids")), pa.array(s)], ["qa", "qb", "a", "b", "ids", "score"])

    return together.mapInArrow(run, "qa long, qb long, a long, b long, ids array<long>, score double").dropDuplicates(["qa", "qb", "a", "b"])


def _sound(df: DataFrame, id_: str, name: str) -> DataFrame:
    """Rows with a vector that has a direction: name, v, dim, and the vector's two names a and b."""
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(id_).cast("long").alias(name), v.alias("v"), F.size(v).alias("dim"), F.xxhash64(v).alias("a"), F.xxhash64(F.lit(SEED), v).alias("b"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = NEAREST, *, tables: int = TABLES, target: int = TARGET, block: int = BLOCK, sample: int = SAMPLE, goal: float = GOAL, least: float = LEAST_RECALL) -> DataFrame:
    """queries, embeddings (vec_id, embedding; other columns are ignored) -> query_id, rank, vec_id, score: each query's k nearest found.

    Nearness is the cosine in double precision; ties go to the smaller vec_id, nulls last. A query's own row (its id and its
    vector) is no candidate; a row that repeats both is one like any other, and a repeated query has rows each. Vectors that are null,
    empty or zero, or hold null or non-finite components, take no part; vectors of different lengths do not meet. Fewer
    candidates than k give fewer rows, none gives none; empty tables give none.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    # The rank is pruned in every task before the exchange, so a vector with many copies sends k + 1 rows a task.
    few = F.row_number().over(W.partitionBy("a", "b", "v").orderBy(F.col("id").asc_nulls_last()))
    nodes = _sound(vectors, "vec_id", "id").withColumn("rank", few).where(F.col("rank") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    nodes = written(nodes.groupBy("a", "b", "v", "dim").agg(ids.alias("ids")), "nodes")
    asking = written(_sound(queries, "vec_id", "query_id"), "queries")
    asked = written(asking.select("a", "b", "dim", "v").dropDuplicates(["a", "b", "v"]), "asked")
    n = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc()).first()
    if n is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    depth = min(DEEPEST, max(1, round(math.log(max(n["n"] / target, 1)) / math.log(2 << max(n["dim"] - 1, 0).bit_length()))))
    probed, _ = fitted_probes(asked, nodes, k, depth, tables=tables, sample=sample, goal=goal, least=least)
    found = candidates(asked, nodes, k + 1, depth, probed, tables=tables, block=block)
    first = F.row_number().over(W.partitionBy("qa", "qb").orderBy(F.col("score").desc(), F.element_at("ids", 1).asc_nulls_last()))
    found = found.withColumn("rank", first).where(F.col("rank") <= k + 1)
    entry = lambda i: F.struct((-F.col("score")).alias("less"), i.isNull().alias("none"), i.alias("id"), ((F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))).alias("same"))
    tops = found.groupBy("qa", "qb").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", entry)))).alias("top"))
    own = F.array_position(F.transform("top", lambda x: F.coalesce(x["same"] & (x["id"] == F.col("query_id")), F.lit(False))), True) - 1
    answered = asking.select("query_id", "a", "b").join(tops, (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))).withColumn("own", own)
    cut = F.slice(F.filter("top", lambda x, i: i != F.col("own")), 1, k)
    return answered.select("query_id", F.posexplode(cut).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def op13_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


#: The same in DuckDB by brute force: equal where every true neighbour is found.
SQL = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, d.e) / (q.n * d.n) DESC, d.vec_id))::INT AS rank,
       d.vec_id, list_dot_product(q.e, d.e) / (q.n * d.n) AS score
FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % {EVERY} = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, d.e) / (q.n * d.n) DESC, d.vec_id) <= {NEAREST}
"""
