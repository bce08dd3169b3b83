"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are one node. Nodes go to the shards of their OVERLAP nearest centroids (spherical k-means over a
bounded sample; at most CENTROIDS, about TARGET nodes each); a shard over BLOCK nodes is cut into blocks that meet in
pairs, so no task holds more than two blocks. Each shard gives its nodes robust-pruned neighbour lists (alpha 1.2,
DEGREE each, and back). The lists of all shards are united by node: what one shard pruned or could not see, another adds.

Search: every node is a query in its shards, over the united lists. A beam search starts from the shard's medoid and
from the node itself; then the range expands: whatever reaches the threshold is expanded in turn until nothing new
reaches it. Pairs found are verified by the cosine in double precision. They connect in every shard that finds them, and are counted in the
first shard that both have in common only. A task returns counts and a spanning forest, not pairs.

Audit: AUDIT nodes in order of a hash, and as many of those with links found, are compared with all nodes by brute force, in
blocks. The recall is the mean over audited nodes that have true links, each node alike. While it is under GOAL, the graph
is built again with twice the overlap (more shards in common is what lost pairs lack), up to all shards for every node; a
graph still under GOAL then is an error, not a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrowops import bounds, runs
from siltstone.llm.common import removed, table, written
from siltstone.llm.components import components

LEAST, OVERLAP, TARGET, CENTROIDS, SAMPLE, BLOCK = 0.9, 3, 1000, 2048, 20_000, 1024
DEGREE, ALPHA, BEAM, AUDIT, GOAL = 16, 1.2, 16, 1000, 0.97


def _matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spread rows; x: unit vectors."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def robust_pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 48) -> np.ndarray:
    """Neighbour lists (-1: none) of unit vectors: of the nearest `pool`, the closest first; each kept one removes those that are alpha times nearer to it."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if pool < 1:
        return out
    for i in range(0, n, 256):
        sim = x[i : i + 256] @ x.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -2
        near = np.argpartition(-sim, pool - 1, 1)[:, :pool]
        s = np.take_along_axis(sim, near, 1)
        order = np.argsort(-s, 1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, order, 1), 0))
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("qad,qbd->qab", x[near], x[near], optimize=True), 0))
        open_, kept = np.ones(near.shape, bool), np.zeros(len(near), np.int64)
        for a in range(pool):
            take = np.flatnonzero(open_[:, a] & (kept < degree))
            out[i + take, kept[take]] = near[take, a]
            kept[take] += 1
            open_[take] &= alpha * between[take, a] > far[take]
            open_[:, a] = False
    return out


def with_back_edges(lists: np.ndarray) -> list[np.ndarray]:
    """Each node's neighbours and those that list it, without repeats."""
    n, degree = lists.shape
    u, v = np.repeat(np.arange(n), degree), lists.ravel()
    u, v = u[v >= 0], v[v >= 0]
    code = np.unique(np.concatenate((u * n + v, v * n + u)))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


#: Neighbours that one step of a search looks up at once; bounds its memory in dense groups.
STEP = 500_000


def range_search(x: np.ndarray, at: np.ndarray, near: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each vector as a query the others at `least` cosine: (query, found). near[at[v] : at[v + 1]]: the neighbours of v.

    All queries walk in step. Beam search from the medoid and each query's own node, then range expansion.
    """
    n = len(x)
    medoid = int((x @ x.sum(0)).argmax())
    seen = np.zeros((n, n), bool)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -2.0)
    closed = np.ones((n, beam), bool)
    q = np.arange(n)
    ids[:, 0], sims[:, 0], closed[:, 0] = q, 1.0, False
    other = q != medoid
    ids[other, 1 % beam], sims[other, 1 % beam], closed[other, 1 % beam] = medoid, x[other] @ x[medoid], False
    seen[q, q] = seen[:, medoid] = True
    hits = [np.stack((q, q), 1)[:0], np.stack((q[other], np.full(int(other.sum()), medoid)), 1)[sims[other, 1 % beam] >= least - 1e-9]]

    degree = np.diff(at)

    def step(q, v):
        """Unseen neighbours of v for q, with their cosines; by query."""
        cuts = np.searchsorted(np.cumsum(degree[v]), np.arange(STEP, int(degree[v].sum()) + STEP, STEP), "right")
        out, begin = [], 0
        for end in [*np.unique(cuts[cuts > 0]).tolist(), len(v)]:
            if end <= begin:
                continue
            d = degree[v[begin:end]]
            place = np.arange(int(d.sum())) - np.repeat(np.cumsum(d) - d, d)
            code = np.unique(np.repeat(q[begin:end], d) * n + near[np.repeat(at[v[begin:end]], d) + place])
            code = code[~seen.ravel()[code]]
            seen.ravel()[code] = True
            qs, vs = np.divmod(code, n)
            s = np.concatenate([np.einsum("nd,nd->n", x[qs[i : i + 50_000]], x[vs[i : i + 50_000]]) for i in range(0, len(qs), 50_000)] or [np.zeros(0)])
            out.append((qs, vs, s))
            begin = end
        qs, vs, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(qs, kind="stable")
        return qs[order], vs[order], s[order]

    live = q
    while len(live):
        best = np.where(closed[live], -3.0, sims[live]).argmax(1)
        live = live[~closed[live, best]] if len(live) else live
        if not len(live):
            break
        best = np.where(closed[live], -3.0, sims[live]).argmax(1)
        closed[live, best] = True
        qs, vs, s = step(live, ids[live, best])
        hits.append(np.stack((qs, vs), 1)[s >= least - 1e-9])
        if not len(qs):
            continue
        cut = bounds(qs)
        width = int(np.diff(cut).max())
        rows = qs[cut[:-1]]
        place = np.arange(len(qs)) - np.repeat(cut[:-1], np.diff(cut))
        row = np.repeat(np.arange(len(rows)), np.diff(cut))
        more_i, more_s = np.full((len(rows), width), -1, np.int64), np.full((len(rows), width), -2.0)
        more_i[row, place], more_s[row, place] = vs, s
        all_i, all_s = np.concatenate((ids[rows], more_i), 1), np.concatenate((sims[rows], more_s), 1)
        all_c = np.concatenate((closed[rows], more_i < 0), 1)
        top = np.argsort(-all_s, 1, kind="stable")[:, :beam]
        ids[rows], sims[rows], closed[rows] = (np.take_along_axis(a, top, 1) for a in (all_i, all_s, all_c))
    found = np.concatenate(hits)
    front = found
    while len(front):
        qs, vs, s = step(front[:, 0], front[:, 1])
        front = np.stack((qs, vs), 1)[s >= least - 1e-9]
        found = np.concatenate((found, front))
    return found[:, 0], found[:, 1]


def _assign(centers: dict[int, np.ndarray], overlap: int):
    """Each node once for each of its shards; shards of the dimension d are numbered from d * 2**20."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == d))
                x = _unit(_matrix(b.column("v").take(rows), int(d)))
                c = centers.get(int(d), np.zeros((1, int(d))))
                k = min(overlap, len(c))
                near = np.concatenate([np.argpartition(-(x[i : i + 2048] @ c.T), k - 1, 1)[:, :k] for i in range(0, len(x), 2048)])
                near = np.sort(near, 1) + int(d) * (1 << 20)
                own = np.repeat(np.arange(len(x)), k)
                pick = lambda name: b.column(name).take(rows).take(pa.array(own))  # noqa: B023, E731
                homes = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * k), pa.array(near[own].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), pick("node"), pick("mult"), pick("dim"), homes, pick("v")], ["shard", "node", "mult", "dim", "homes", "v"])

    return run


def _groups(t: pa.Table):
    """Slices of one shard and pair of blocks each."""
    at = bounds(*[t.column(c).to_numpy() for c in ("shard", "lo", "hi")])
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        yield t.slice(i, j - i)


def _neighbours(batches):
    for t in runs(batches, ["shard", "lo", "hi"]):
        for g in _groups(t):
            if g.num_rows > 1:
                node = g.column("node").to_numpy()
                x = _unit(_matrix(g.column("v"), g.column("dim")[0].as_py()))
                near = with_back_edges(robust_pruned(x))
                sizes = np.cumsum([0, *map(len, near)])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(node[np.concatenate(near)]))], ["node", "near"])


def _linked(least: float):
    def run(batches):
        for t in runs(batches, ["shard", "lo", "hi"]):
            for g in _groups(t):
                if g.num_rows < 2:
                    continue
                node, own, mult = (g.column(c).to_numpy() for c in ("node", "own", "mult"))
                shard, lo, hi = (g.column(c)[0].as_py() for c in ("shard", "lo", "hi"))
                raw = _matrix(g.column("v"), g.column("dim")[0].as_py())
                x = _unit(raw)
                order = np.argsort(node)
                near = g.column("near").combine_chunks()
                sizes = np.diff(near.offsets.to_numpy())
                flat = near.flatten().to_numpy()
                at = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
                here = node[order][at] == flat  # neighbours that are in this shard too
                of, to = np.repeat(np.arange(len(node)), sizes)[here], order[at[here]]
                begin = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(node)))))
                q, v = range_search(x, begin, to, least)
                pair = np.unique(np.minimum(q, v) * len(node) + np.maximum(q, v))
                u, v = np.divmod(pair, len(node))
                size = np.sqrt((raw * raw).sum(1))
                cosine = np.concatenate([np.einsum("nd,nd->n", raw[u[i : i + 50_000]], raw[v[i : i + 50_000]]) for i in range(0, len(u), 50_000)] or [np.zeros(0)]) / (size[u] * size[v])
                homes = np.array(g.column("homes").to_pylist())
                first_common = lambda a, b: np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
                common = np.concatenate([first_common(homes[u[i : i + 50_000]], homes[v[i : i + 50_000]]) for i in range(0, len(u), 50_000)] or [np.zeros(0, np.int64)])
                ok = (u != v) & (cosine >= least) & ((lo == hi) | (own[u] != own[v]))
                u, v, first = u[ok], v[ok], common[ok] == shard
                links = np.bincount(u[first], mult[v[first]], len(node)) + np.bincount(v[first], mult[u[first]], len(node))
                label = np.arange(len(node))
                while True:
                    new = label.copy()
                    np.minimum.at(new, u, label[v])
                    np.minimum.at(new, v, label[u])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                some = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[label[some]])], ["node", "links", "root"])

    return run


def links(nodes: DataFrame, *, least: float = LEAST, overlap: int = OVERLAP, target: int = TARGET, block: int = BLOCK) -> DataFrame:
    """nodes (node, v, dim, mult; distinct vectors) -> node, links, root; a row for each node and shard in which it has links or another root."""
    sample = nodes.orderBy("node").limit(SAMPLE).select("v", "dim").toArrow()
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc()).limit(64).collect()}
    centers = {}
    for d, n in sizes.items():
        mine = sample.filter(pa.compute.equal(sample.column("dim"), d))
        if mine.num_rows:
            centers[d] = centroids_of(_unit(_matrix(mine.column("v"), d)), max(1, min(CENTROIDS, n // target, mine.num_rows)))
    kind = nodes.schema["v"].dataType.simpleString()
    columns = f"shard long, node long, mult long, dim int, homes array<long>, v {kind}"
    dealt = nodes.mapInArrow(_assign(centers, overlap), columns)
    blocks = dealt.groupBy(F.col("shard").alias("s")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = (
        dealt.join(blocks, F.col("shard") == F.col("s"))
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "mult", "dim", "homes", "v")
    )
    dealt = written(dealt, "shards")
    together = lambda x: x.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
    near = together(dealt).mapInArrow(_neighbours, "node long, near array<long>").groupBy(F.col("node").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return together(dealt.join(near, F.col("node") == F.col("id")).drop("id")).mapInArrow(_linked(least), "node long, links long, root long")


def recall(nodes: DataFrame, counted: DataFrame, *, least: float = LEAST, audit: int = AUDIT) -> float:
    """Mean share of the true links that was found, over audited nodes with true links, by brute force against all nodes; 1 without true links. counted: node, links.

    Audited are the first `audit` nodes in order of a hash, and the first `audit` of those with links found.
    """
    linked = counted.where("links > 0").select("node").distinct()
    some = nodes.orderBy(F.xxhash64("node")).limit(audit).union(nodes.join(linked, "node", "left_semi").select(nodes.columns).orderBy(F.xxhash64("node")).limit(audit))
    asked = some.select("node", "v", "dim").dropDuplicates(["node"]).toArrow().to_pylist()

    def true_links(batches):
        for b in batches:
            dims, mult, out = b.column("dim").to_numpy(), b.column("mult").to_numpy(), []
            for d in np.unique(dims):
                mine = [a for a in asked if a["dim"] == d]
                if mine:
                    rows = np.flatnonzero(dims == d)
                    x = _unit(_matrix(b.column("v").take(pa.array(rows)), int(d)))
                    node = b.column("node").to_numpy()[rows]
                    y = _unit(np.array([a["v"] for a in mine], np.float64))
                    ids = np.array([a["node"] for a in mine])
                    for i in range(0, len(x), 2048):
                        hit = (y @ x[i : i + 2048].T >= least) & (ids[:, None] != node[None, i : i + 2048])
                        out.append((ids, hit @ mult[rows[i : i + 2048]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64))], ["node", "truth"])

    truth = nodes.mapInArrow(true_links, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    found = counted.groupBy(F.col("node").alias("id")).agg(F.sum("links").alias("links"))
    share = F.least("truth", F.coalesce("links", F.lit(0))) / F.col("truth")
    mean = truth.where("truth > 0").join(found, F.col("node") == F.col("id"), "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(vectors: DataFrame, *, least: float = LEAST, overlap: int = OVERLAP, target: int = TARGET, block: int = BLOCK, goal: float = GOAL) -> DataFrame:
    """embeddings (vec_id, embedding; other columns are ignored) -> vec_id, n_links, component_id, kept; a row a vector.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
    lengths do not link. Rows without id link, but name no component. Repeated rows link with each other. An empty table gives none.
    """
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(sound, v).alias("v"))
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    nodes = written(nodes.select(F.xxhash64("v").alias("node"), "v", F.size("v").alias("dim"), "low", "mult"), "nodes")
    while True:
        found = written(links(nodes.drop("low"), least=least, overlap=overlap, target=target, block=block), "links")
        reached = recall(nodes, found, least=least)
        if reached >= goal:
            break
        if overlap >= CENTROIDS:
            raise RuntimeError(f"recall {reached:.4f} of links is under {goal}")
        removed(vectors.sparkSession, found)
        overlap *= 2
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("node").alias("c")).agg(F.sum("links").alias("links"))
    rooted = (
        nodes.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left")
        .join(counts, F.col("node") == F.col("c"), "left")
        .select("v", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    lows = rooted.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    named = rooted.join(lows, F.col("root") == F.col("r")).select(F.col("v").alias("w"), "n_links", "component")
    linked = rows.where("v is not null").join(named, F.col("v") == F.col("w")).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embeddings(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same in DuckDB, by all pairs; the graph's recall is audited, so results agree where it finds every link.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings
), links AS (
  SELECT a.r AS x, b.r AS y FROM v a, v b
  WHERE a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {LEAST}::DOUBLE
), reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.x = v.r)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT reach.x, min(w.vec_id) AS c FROM reach JOIN v w ON w.r = reach.y GROUP BY reach.x) m ON m.x = v.r
"""
