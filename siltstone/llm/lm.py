"""Language-model scores: context-tree weighting over bytes, beside an add-half word unigram.

Model. Texts in ASCII lower case, closed by the byte END, which UTF-8 never uses; before a text stand DEPTH
line feeds. Each byte is eight binary decisions (the 255 inner nodes of the byte tree). For each decision there is
a context tree over the last 0..DEPTH bytes, whose nodes hold Krichevsky-Trofimov estimates, and the estimates of
all depths are mixed by the context-tree weights P_w = 1/2 P_kt + 1/2 (product of the children's P_w). Every context
met is a node, however rare. Counts are final when texts are scored, so each bit has the mixture along its
context's path, and each (context, byte) has one code length, computed once. A text's score is the sum of those, as log10.

Training. Each task counts its (DEPTH + 1)-grams with NumPy and its words by 64-bit hashes (equal for two of n words with
a chance of n * n / 2**65), and hands over partial counts; Spark sums them, over all documents: n in the training rows, m in
all. The tree is weighted in two passes over the distinct grams, dealt by their last TOP + 1 bytes, so that each subtree
under depth TOP is in one task: upwards, where the subtrees' weights are summed into the contexts of TOP bytes; and
downwards from those, to a code length for each gram. The top of the tree (2**16 contexts at most) is on the driver.

Scoring. Keys that are at least one in 2**COMMON of all (so 2**COMMON grams and as many words at most) are broadcast
with their values; all others meet theirs in a shuffle join, one row for each text and key, in which no key can be hot.
Which keys go which way changes no result.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrowops import bounds, hashed_words, runs, steps
from siltstone.llm.common import fresh, table, written

DEPTH, TOP, COMMON, END = 5, 2, 21, 0xFF
#: Distinct keys a task holds before it hands them over.
FLUSH = 500_000
#: The end token's key: the hash of no bytes.
STOP = np.uint64(0)
WORD, GRAM, HEAD = 0, 1, 2


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its END: its predecessors and itself in one number, the nearest predecessor in front, the byte last; and the text's place."""
    pad, end = b"\n" * depth, bytes([END])
    joined = np.frombuffer(b"".join(x for t in texts for x in (pad, t.lower(), end)), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    own = np.ones(len(joined), bool)
    first = np.cumsum(sizes + depth) - sizes
    for d in range(1, depth + 1):
        own[first - d] = False
    at = np.flatnonzero(own)
    packed = joined[at].astype(np.uint64)
    for d in range(1, depth + 1):
        packed |= joined[at - d].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
    return packed, np.repeat(np.arange(len(texts)), sizes)


_TABLE = 1 << 14
_HALVES, _WHOLES = (np.array([lgamma(i + x) for i in range(_TABLE)]) for x in (0.5, 1))


def _lgamma(n: np.ndarray, x: float) -> np.ndarray:
    """Log gamma of n + x for whole n; x is a half or one."""
    out = (_HALVES if x == 0.5 else _WHOLES)[np.minimum(n, _TABLE - 1)]
    big = n >= _TABLE
    if big.any():
        y = n[big] + x
        out[big] = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y)
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - np.log(np.pi) - _lgamma(zeros + ones, 1)


class Nodes:
    """Nodes of one decision and depth: keys (context << 8 | decision) ascending, counts of bit 0 and bit 1, log of the weighted probability, share of the node's own estimate in it."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = _log_kt(zeros, ones)
        self.log = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.exp(own - np.log(2) - self.log)

    def up(self) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Keys of the contexts shorter by the oldest byte, which of them each node has, and what their nodes sum up."""
        keys, of = np.unique(self.keys >> 16 << 8 | self.keys & 255, return_inverse=True)
        add = lambda x: np.bincount(of, x, len(keys))
        return keys, of, (add(self.zeros).astype(np.int64), add(self.ones).astype(np.int64), add(self.log))

    @property
    def estimate(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def _subtrees(packed: np.ndarray, n: np.ndarray, depth: int, top: int):
    """For each of the eight levels of decisions: which node each gram (ascending) is in and its bit, the nodes from depth `depth` up to `top` + 1 with their parents' places, and the keys and sums at `top`."""
    packed = packed.astype(np.int64)
    for level in range(8):
        key = packed >> 8 << 8 | 1 << level | (packed & 255) >> (8 - level)
        at, bit = bounds(key), packed >> (7 - level) & 1
        ones = np.add.reduceat(n * bit, at[:-1])
        nodes = Nodes(key[at[:-1]], np.add.reduceat(n, at[:-1]) - ones, ones)
        path = []
        for d in range(depth, top, -1):
            keys, of, sums = nodes.up()
            path.append((nodes, of))
            if d > top + 1:
                nodes = Nodes(keys, *sums)
        yield np.repeat(np.arange(len(at) - 1), np.diff(at)), bit, path, keys, sums


def _upward(depth: int, top: int):
    """Sums of the subtrees at the contexts of `top` bytes; partial ones, a row for each run and node."""

    def run(batches):
        for t in runs(batches, ["stem"]):
            parts = [(keys, *sums) for *_, keys, sums in _subtrees(t.column("key").to_numpy(), t.column("n").to_numpy(), depth, top)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["node", "zeros", "ones", "below"])

    return run


def _crown(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the sums at depth `top`: keys (ascending), what depths 0 to `top` give to the probability of bit 1, and the weight left for longer contexts."""
    order = np.argsort(node)
    nodes, path = Nodes(node[order], zeros[order], ones[order], below[order]), []
    for _ in range(top):
        keys, of, sums = nodes.up()
        path.append((nodes, of))
        nodes = Nodes(keys, *sums)
    given, left = nodes.stop * nodes.estimate, 1 - nodes.stop
    for nodes, of in reversed(path):
        given, left = given[of] + left[of] * nodes.stop * nodes.estimate, left[of] * (1 - nodes.stop)
    return nodes.keys, given, left


def _downward(depth: int, top: int, crown):
    """key, cost: -log10 of the probability of the gram's last byte after the others."""

    def run(batches):
        keys, given_top, left_top = crown.value
        for t in runs(batches, ["stem"]):
            key = t.column("key").to_numpy()
            cost = np.zeros(len(key))
            for in_node, bit, path, up, _ in _subtrees(key, t.column("n").to_numpy(), depth, top):
                at = np.searchsorted(keys, up)
                given, left = given_top[at], left_top[at]
                for nodes, of in path[:0:-1]:
                    given, left = given[of] + left[of] * nodes.stop * nodes.estimate, left[of] * (1 - nodes.stop)
                nodes, of = path[0]
                p = np.clip(given[of] + left[of] * nodes.estimate, 1e-12, 1 - 1e-12)
                cost -= np.log10(np.where(bit == 1, p[in_node], 1 - p[in_node]))
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(cost)], ["key", "cost"])

    return run


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = bounds(keys)[:-1]
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(text: str, depth: int):
    """Partial counts of words (by hash) and grams: kind, key, n (in training rows), m (in all rows)."""

    def batch(kind, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())], ["kind", "key", "n", "m"])

    def run(batches):
        hold = {WORD: [], GRAM: []}
        for b, texts in steps(batches, text):
            train = b.column("train").to_numpy(zero_copy_only=False)
            for flag in (True, False):
                part = [x for x, f in zip(texts, train) if f == flag]
                if part:
                    words, _ = hashed_words([x.lower() for x in part])
                    for kind, x in ((WORD, np.append(words, np.full(len(part), STOP))), (GRAM, grams(part, depth)[0])):
                        x = np.sort(x)
                        at = bounds(x)
                        times = np.diff(at)
                        hold[kind].append((x[at[:-1]], np.stack((times * flag, times), 1)))
            for kind, parts in hold.items():
                if sum(len(k) for k, _ in parts) > 3 * FLUSH:
                    parts[:] = [_summed(parts)]
                    if len(parts[0][0]) > FLUSH:
                        yield batch(kind, *parts.pop())
        for kind, parts in hold.items():
            if parts:
                yield batch(kind, *_summed(parts))

    return run


def train(rows: DataFrame, text: str, *, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """rows (text, train) -> costs (key, m, cost: code length of each gram met, in decimal digits) and words (key, n, m). Null text is an end token only.

    Both tables are written and grow with the corpus; grams and words of other than training rows are in them too, with n = 0.
    """
    spark, top = rows.sparkSession, min(TOP, depth - 1)
    counts = rows.select(text, "train").mapInArrow(_counted(text, depth), "kind int, key long, n long, m long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "lm-counts")
    stems = counts.where(F.col("kind") == GRAM).select("key", "n", F.shiftright("key", 8 * (depth - top)).alias("stem")).repartition("stem").sortWithinPartitions("key")
    sums = stems.mapInArrow(_upward(depth, top), "node long, zeros long, ones long, below double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    columns = [sums.column(c).to_numpy() for c in ("node", "zeros", "ones", "below")]
    crown = spark.sparkContext.broadcast(_crown(*columns, top) if len(columns[0]) else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
    costs = stems.mapInArrow(_downward(depth, top, crown), "key long, cost double")
    costs = written(costs, "lm-costs").join(counts.where(F.col("kind") == GRAM).select("key", "m"), "key")
    return costs, counts.where(F.col("kind") == WORD).select("key", "n", "m")


def _often(df: DataFrame, value: str, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (ascending) that are at least one in 2**common of all, and their values."""
    whole = df.agg(F.sum("m")).first()[0] or 0
    got = df.where(F.col("m") * F.lit(1 << common) >= F.lit(whole)).select("key", value).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column(value).to_numpy()[order]


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked keys, and which are there."""
    at = np.searchsorted(keys, asked)
    there = at < len(keys)
    there[there] = keys[at[there]] == asked[there]
    return at, there


def score(docs: DataFrame, held_out, *, depth: int = DEPTH, common: int = COMMON) -> DataFrame:
    """documents (doc_id, text; other columns are ignored) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte; a row a document.

    Trains on the rows where the condition `held_out` is false or null and scores all. n_bytes counts the END;
    bits_per_byte is the model's code length over it. Null text is empty: one end token. Without training rows every
    byte has the uniform probability and the base score is 0. Null and repeated ids are rows like any other; an empty
    table gives none.
    """
    spark = docs.sparkSession
    t, row = fresh(["doc_id", "held_out", "train", *docs.columns], "text", "row")
    flag = F.coalesce(held_out, F.lit(False))
    costs, words = train(docs.select(F.col("text").alias(t), (~flag).alias("train")), t, depth=depth)
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    shared = spark.sparkContext.broadcast((_often(costs, "cost", common), _often(words, "n", common)))

    def scored(batches):
        (grams_often, prices), (words_often, counts) = shared.value
        logs = np.log10(counts + 0.5)
        for b, texts in steps(batches, t):
            n = len(texts)
            words, sizes = hashed_words([x.lower() for x in texts])
            every = np.arange(n)
            words, owner = np.append(words, np.full(n, STOP)), np.append(np.repeat(every, sizes), every)
            at, there = _found(words_often, words)
            n_known = np.bincount(owner[there], counts[at[there]] > 0, n)
            base = np.bincount(owner[there], logs[at[there]], n)
            words, owner = words[~there], owner[~there]
            order = np.lexsort((words, owner))
            words, owner = words[order], owner[order]
            cut = bounds(owner, words)
            rare, of, times = [words[cut[:-1]]], [owner[cut[:-1]]], [np.diff(cut)]
            packed, place = grams(texts, depth)
            if depth < 6 and n <= 1 << 16:  # gram and text in one number
                both = np.sort(packed << np.uint64(16) | place.astype(np.uint64))
                cut = bounds(both)
                packed, place = both[cut[:-1]] >> np.uint64(16), (both[cut[:-1]] & np.uint64(0xFFFF)).astype(np.int64)
            else:
                order = np.lexsort((place, packed))
                packed, place = packed[order], place[order]
                cut = bounds(packed, place)
                packed, place = packed[cut[:-1]], place[cut[:-1]]
            often = np.diff(cut)
            at, there = _found(grams_often, packed)
            own = -np.bincount(place[there], prices[at[there]] * often[there], n)
            rare.append(packed[~there])
            of.append(place[~there])
            times.append(often[~there])
            kind = np.repeat([HEAD, WORD, GRAM], [n, len(rare[0]), len(rare[1])]).astype(np.int32)
            rare, of, times = np.concatenate(rare), np.concatenate(of), np.concatenate(times)
            m = len(rare)
            rows = b.column(row).to_numpy()
            heads = lambda x, like: np.concatenate((x, np.zeros(m, like)))  # noqa: B023, E731
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((rows, rows[of]))),
                    pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                    pa.concat_arrays([b.column("held_out"), pa.nulls(m, pa.bool_())]),
                    pa.array(heads(sizes + 1, np.int64)),
                    pa.array(heads(np.array([len(x) + 1 for x in texts]), np.int64)),
                    pa.array(heads(n_known.astype(np.int64), np.int64)),
                    pa.array(heads(base, np.float64)),
                    pa.array(heads(own, np.float64)),
                    pa.array(kind),
                    pa.array(np.concatenate((rows * np.int64(-7046029254386353131), rare.view(np.int64)))),
                    pa.array(np.concatenate((np.zeros(n, np.int64), times))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score", "kind", "key", "times"],
            )

    like = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", flag.alias("held_out"), F.col("text").alias(t), F.monotonically_increasing_id().alias(row))
    # One row a document with what its common keys give (kind HEAD, key by chance), and one for each other key of it.
    parts = rows.mapInArrow(scored, f"row long, doc_id {like}, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double, kind int, key long, times long")
    none = F.lit(None)
    terms = words.select(F.lit(WORD).alias("k"), F.col("key").alias("term"), "n", none.cast("double").alias("cost")).union(costs.select(F.lit(GRAM), "key", none.cast("long"), "cost"))
    joined = parts.join(terms, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("term")), "left")
    word = F.col("kind") == WORD
    per_row = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("n_known") + F.when(word & (F.col("n") > 0), F.col("times")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + F.when(word, F.col("times") * F.log10(F.col("n") + F.lit(0.5))).otherwise(F.lit(0.0))).alias("base"),
        F.sum(F.col("score") - F.when(F.col("kind") == GRAM, F.col("times") * F.col("cost")).otherwise(F.lit(0.0))).alias("score"),
    )
    whole = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    return per_row.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def fold(column, n: int):
    """crc32 of the id as text, mod 5, is n."""
    return F.crc32(F.col(column).cast("string")) % 5 == n


def op6_lm(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 1))
