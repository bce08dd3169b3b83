"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Fingerprints within `radius` differing bits differ in at most `radius` bytes, so they
agree in at least 8 - radius byte positions: the guaranteed minimum. Postings of single bytes would join each
document with one in 256 of all others; the index therefore holds postings of byte groups that any pair at the
minimum must share. With radius 3 the minimum is 5 of 8; of 5 positions at least 3 lie in one half, so the 8
groups of 3 bytes within a half (24-bit keys) meet every such pair. For each pair met, the shared positional
bytes are tallied, pairs under the minimum are dropped, and the Hamming distance verifies the rest.

Equal fingerprints are one node from the start, keys with one node are dropped, and keys with many nodes are cut
into blocks that meet each other in pairs, so no task holds more than two blocks. A task returns a spanning forest
of the links it verified, not the pairs: components are the same, and rows stay linear in a group's size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrowops import bounds, runs, steps
from siltstone.llm.common import fresh, table, written
from siltstone.llm.components import components

SHINGLE, SEED, RADIUS, BLOCK = 3, 42, 3, 1024
#: Which bits each byte value sets.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: bytes, k: int, seed: int = SEED) -> list[int]:
    """XXH64 of each k-word shingle of the text in ASCII lower case, space-joined; fewer words: the whole sequence; none: nothing."""
    words = text.lower().split()
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip([0, *ends[: len(words) - k].tolist()], (ends[k - 1 :] - 1).tolist())]


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """Bit i is 1 if set in over half of a document's hashes; none: zero. Counts bytes by value, then bits by byte value."""
    sizes = np.array([len(h) for h in hashes])
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    owner, n = np.repeat(np.arange(len(sizes)), sizes) * 256, len(sizes)
    octets, out = flat.astype("<u8").view(np.uint8).reshape(-1, 8), np.zeros((n, 64), bool)
    for j in range(8):
        counts = np.bincount(owner + octets[:, j], minlength=n * 256).reshape(n, 256)
        out[:, 8 * j : 8 * j + 8] = counts @ _BITS * 2 > sizes[:, None]
    return np.packbits(out, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, *, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each whole text; null text is empty and has fingerprint zero."""
    t = fresh(docs.columns, "text")[0]
    rows = docs.select("doc_id", F.col("text").alias(t))

    def fps(batches):
        for b, texts in steps(batches, t):
            done, at = [], 0
            while at < len(texts):
                part = texts[at : at + 128]
                done.append(fingerprints_of([shingle_hashes(x, k) for x in part]))
                at += 128
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(done).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(fps, rows.select("doc_id").schema.add("fp", "long"))


def byte_groups(radius: int) -> list[tuple[int, ...]]:
    """Byte positions of each posting list: any two fingerprints that agree in 8 - radius positions agree on one group.

    Positions are cut into two halves; one half holds at least half of the agreeing ones. Holds for radius 0 to 6.
    """
    size = -(-(8 - radius) // 2)
    return [g for half in (range(4), range(4, 8)) for g in combinations(half, size)]


def _linked(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Tally of shared positional bytes, count filter, then the distance: which of x link with which of y."""
    diff = x[:, None] ^ y[None, :]
    shared = np.zeros(diff.shape, np.uint8)
    for j in range(8):
        shared += (diff >> np.uint64(8 * j)).astype(np.uint8) == 0
    return (shared >= 8 - radius) & (np.bitwise_count(diff) <= radius)


def forest(x: np.ndarray, linked) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each linked node but the roots of the graph over x, where linked(i, j) gives the links between two slices of x."""
    n = len(x)
    label = np.arange(n)
    pairs = [np.argwhere(linked(x[i : i + 256], x)) + [i, 0] for i in range(0, n, 256)]
    u, v = np.concatenate(pairs).T if pairs else (label[:0], label[:0])
    keep = u > v
    u, v = u[keep], v[keep]
    while len(u):  # labels fall until both ends of each link agree; roots jump to their own roots
        a, b = label[u], label[v]
        if (a == b).all():
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    moved = np.flatnonzero(label != np.arange(n))
    return x[moved], x[label[moved]]


def links(fps: DataFrame, *, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> a, b: verified links that connect what all links within `radius` connect."""
    packed = []
    for i, group in enumerate(byte_groups(radius)):
        key = F.lit(i).cast("long")
        for j in group:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * j).bitwiseAND(F.lit(255)))
        packed.append(key)
    keys = F.explode(F.array(*packed))
    posted = fps.select("fp", keys.alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    met = (
        posted.join(shared, F.col("key") == F.col("k"))
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("fp", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )

    def linked(batches):
        for t in runs(batches, ["key", "lo", "hi"]):
            key, lo, hi = (t.column(c).to_numpy() for c in ("key", "lo", "hi"))
            fp = t.column("fp").to_numpy().view(np.uint64)
            at = bounds(key, lo, hi)
            out = []
            sizes = np.diff(at)
            for i in at[:-1][sizes == 2]:
                d = int(fp[i] ^ fp[i + 1])
                if d.bit_count() <= radius:
                    out.append((fp[i : i + 1], fp[i + 1 : i + 2]))
            out += [forest(fp[i : i + n], lambda x, y: _linked(x, y, radius)) for i, n in zip(at[:-1], sizes) if n > 2]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)], ["a", "b"])

    return met.mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """documents (doc_id, text; other columns are ignored) -> doc_id, fingerprint (16 hex digits), component_id; a row a document.

    component_id is the smallest doc_id reachable by links of at most `radius` differing bits, itself included.
    Null and empty texts have fingerprint zero and link like any other. Null ids have no part in a minimum; a
    component of nulls has a null id. Repeated rows are rows. An empty table gives none.
    """
    fps = written(fingerprints(docs, k=k), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), radius=radius))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
