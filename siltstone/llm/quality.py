"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are ratios of character classes and words, the same of the line before and
the line after, and whether it is the first or last. The chain's transitions tie neighbours together.

Training takes a bounded sample of labelled documents, whole: SAMPLE rows in order of a hash, of which those count that fit
into LINES lines in all (a document that no longer fits is passed over). Only documents have labels, so the lines' own are
latent: at first every line carries its document's, and the weights of the features are fitted without steps (which
would tie a whole document together); then, in turns, lines that are surely seen otherwise change their label and the
chain is fitted to the lines' labels (conditional likelihood, full-batch Adam in NumPy on the driver). Lines change the
surest first, as long as at least half of the document's length agrees with its label. So a document may hold lines of
both kinds, and the chain learns the steps between them.

Scoring runs on the executors over whole texts: forward-backward gives each line's probability of being good, the mean
weighted by line length is the document's raw quality, and a two-parameter logistic curve fitted on the sample turns it
into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowops import hashed_spans, steps
from siltstone.llm.common import bounded_batches, fresh, named, table

SAMPLE, LINES, ROUNDS, RIDGE, THRESHOLD = 6000, 200_000, (150, 60, 60), 1e-4, 0.3

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:", b"!", b"?", b"|", b"*#$%&@^~=+<>\\/_{}[]", b"'\"()-`", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))), 1):
    _CLASS[list(_chars)] = _i
_K = 13


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of all texts, the lines' lengths, and how many lines each text has (at least one)."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, length = len(ends), ends - starts
    sizes = np.diff(np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1, prepend=0)
    line = np.repeat(np.arange(n), length + 1)
    c = np.bincount(line * _K + _CLASS[joined], minlength=n * _K).reshape(n, _K).astype(np.float64)
    blank = np.concatenate(([True], (joined == 32) | (joined == 9) | (joined == 10)))
    w0 = np.flatnonzero(~blank[1:] & blank[:-1])
    w1 = np.flatnonzero(blank[1:] & ~blank[:-1])
    words = np.bincount(line[w0], minlength=n).astype(np.float64)
    short = np.bincount(line[w0[w1 - w0 <= 3]], minlength=n)
    h = hashed_spans(joined, w0, w1)
    same = np.bincount(line[w0[1:][(h[1:] == h[:-1]) & (line[w0[1:]] == line[w0[:-1]])]], minlength=n)
    letters = c[:, 1] + c[:, 2] + c[:, 12]
    per_word = lambda x: np.minimum(x / np.maximum(words, 1), 4)
    first = joined[starts]
    last = np.where(length > 0, joined[np.maximum(ends - 1, 0)], 10)
    own = np.stack(
        [
            c[:, 2] / np.maximum(letters, 1), c[:, 3] / np.maximum(length, 1), per_word(c[:, 5]), per_word(c[:, 6]), per_word(c[:, 7]), per_word(c[:, 8]), per_word(c[:, 9]), per_word(c[:, 10]),
            c[:, 12] / np.maximum(letters, 1), short / np.maximum(words, 1), per_word(letters + 0.0) / 10, np.log1p(words), np.log1p(length) / 2, words == 0, words < 3, (last == 46) | (last == 63) | (last == 33), (first >= 65) & (first <= 90), np.log1p(per_word(c[:, 9] + c[:, 6] + c[:, 8])), same / np.maximum(words, 1),
        ],
        1,
    ).astype(np.float64)
    return beside(own, sizes), length + 1, sizes


#: Features of a line that are its own.
OWN = 19


def beside(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All features of each line, of the type of `own`: its own, those of the line before and the line after, and whether it is the first or last."""
    out = np.zeros((len(own), 3 * OWN + 3), own.dtype)
    last = np.cumsum(sizes) - 1
    first = last + 1 - sizes
    out[:, :OWN], out[1:, OWN : 2 * OWN], out[:-1, 2 * OWN : 3 * OWN] = own, own[:-1], own[1:]
    out[first, OWN : 2 * OWN], out[last, 2 * OWN : 3 * OWN] = 0, 0
    out[first, -3], out[last, -2], out[:, -1] = 1, 1, 1
    return out


#: Lines of a chain that are worked off one after the other; longer chains are cut into runs of so many, worked side by side.
RUN = 512


def _by_place(first: np.ndarray, sizes: np.ndarray):
    """Runs in order of length, longest first; for each place t the lines of those that have a line t, and that order."""
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
    return [first[order[:a]] + t for t, a in enumerate(alive)], order


def marginals(score: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward. score: of good against bad for each line; move[a, b]: of a step from a to b.

    Gives each line's log-odds of being good, the expected number of each step, and the sum of the chains' log partitions.
    Chains over RUN lines are cut into runs. What a run makes of each state before it is a 2 x 2 matrix; the matrices of a chain are
    multiplied from run to run, which gives what enters each run from either side, and then all runs are swept at once.
    """
    onward = lambda x: np.stack([np.logaddexp(x[:, 0] + move[0, b], x[:, 1] + move[1, b]) for b in (0, 1)], 1)
    backward = lambda y: np.stack([np.logaddexp(y[:, 0] + move[a, 0], y[:, 1] + move[a, 1]) for a in (0, 1)], 1)
    runs = -(-sizes // RUN)
    chain = np.repeat(np.arange(len(sizes)), runs)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = (np.cumsum(sizes) - sizes)[chain] + nth * RUN
    length = np.minimum(sizes[chain] - nth * RUN, RUN)
    places, order = _by_place(first, length)
    node = np.stack((np.zeros_like(score), score), 1)
    fwd, bwd = node.copy(), np.zeros_like(node)
    if len(chain) > len(sizes):
        through = []  # from a start, and from either state before the run, to the states of its last line
        for x in (node[first], node[first] + move[0], node[first] + move[1]):
            x = x[order]
            for now in places[1:]:
                x[: len(now)] = onward(x[: len(now)]) + node[now]
            through.append(np.empty_like(x))
            through[-1][order] = x
        begin, low, high = through
        at = np.argsort(nth, kind="stable")
        cut = np.searchsorted(nth[at], np.arange(nth.max() + 2))
        for i, j in zip(cut[1:-1], cut[2:]):
            r = at[i:j]
            before = begin[r - 1]
            begin[r] = np.stack([np.logaddexp(before[:, 0] + low[r, b], before[:, 1] + high[r, b]) for b in (0, 1)], 1)
            fwd[first[r]] += onward(before)
        after = np.zeros_like(begin)
        for i, j in zip(cut[-2:0:-1], cut[:0:-1]):
            r = at[i:j]
            after[r - 1] = np.stack([np.logaddexp(m[r, 0] + after[r, 0], m[r, 1] + after[r, 1]) for m in (low, high)], 1)
        bwd[first + length - 1] = after
    for before, now in zip(places, places[1:]):
        fwd[now] += onward(fwd[before[: len(now)]])
    for before, now in zip(places[-2::-1], places[:0:-1]):
        bwd[before[: len(now)]] = backward(bwd[now] + node[now])
    last = np.cumsum(sizes) - 1
    total = np.logaddexp(fwd[last, 0], fwd[last, 1])
    inside = np.ones(len(score), bool)
    inside[last] = False
    t = np.flatnonzero(inside)
    of = np.repeat(total, sizes)[t]
    pairs = np.array([[np.exp(fwd[t, a] + move[a, b] + node[t + 1, b] + bwd[t + 1, b] - of).sum() for b in (0, 1)] for a in (0, 1)])
    both = fwd + bwd
    return both[:, 1] - both[:, 0], pairs, float(total.sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _adam(gradient, x: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return x


def relabelled(label: np.ndarray, logit: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Labels of the lines: their document's, but for lines of the other sign, the surest first, while at most half of the document's length has turned.

    The first line that would pass the half ends it: what is less sure stays, however short it is. Half itself may turn.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    agrees = np.where(label[doc] == 1, logit, -logit)
    order = np.lexsort((agrees, doc))
    run = np.cumsum(weight[order])
    first = np.cumsum(sizes) - sizes
    before = np.concatenate(([0], run))[first]
    whole = np.add.reduceat(weight, first)
    out = label[doc].copy()
    flip = (agrees[order] < 0) & (2 * (run - before[doc]) <= whole[doc])
    out[order[flip]] = 1 - out[order[flip]]
    return out


class Model:
    """Weights of the chain, and the curve from the raw quality to a probability. Without labels of both kinds everything is good."""

    def __init__(self, x=None, weight=None, sizes=None, label=None, rounds: tuple[int, ...] = ROUNDS, ridge: float = RIDGE):
        self.ready = x is not None and len(sizes) > 1 and 0 < label.mean() < 1
        if not self.ready:
            return
        self.mean, self.scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        z = x - self.mean
        z /= self.scale
        inside = np.ones(len(z), bool)
        inside[np.cumsum(sizes) - 1] = False
        step = np.flatnonzero(inside)

        def gradient_for(lines, tied):
            seen = np.bincount(2 * lines[step] + lines[step + 1], minlength=4).astype(np.float64)

            def gradient(p):
                logit, pairs, _ = marginals(z @ p[4:], p[:4].reshape(2, 2), sizes)
                return np.concatenate(((pairs.ravel() - seen) * tied, z.T @ (_sigmoid(logit) - lines))) / len(lines) + ridge * p

            return gradient

        p, lines = np.zeros(4 + z.shape[1]), np.repeat(label, sizes)
        for i, n in enumerate(rounds):
            p = _adam(gradient_for(lines, i > 0), p, n, 0.05)
            lines = relabelled(label, marginals(z @ p[4:], p[:4].reshape(2, 2), sizes)[0], weight, sizes)
        self.move, self.w, self.curve = p[:4].reshape(2, 2), p[4:], np.array([1.0, 0.0])
        raw = self._raw(weight, sizes, marginals(z @ self.w, self.move, sizes)[0])
        fit = lambda q: np.array([((_sigmoid(q[0] * raw + q[1]) - label) * raw).mean(), (_sigmoid(q[0] * raw + q[1]) - label).mean()]) + 1e-3 * np.array([q[0] - 1, 0])
        self.curve = _adam(fit, self.curve, 500, 0.05)

    def line_logits(self, x) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def _raw(self, weight, sizes, logit) -> np.ndarray:
        at = np.cumsum(sizes) - sizes
        q = np.add.reduceat(_sigmoid(logit) * weight, at) / np.add.reduceat(weight.astype(np.float64), at)
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, its number of lines, and how many of them are good."""
        x, weight, sizes = line_features(texts)
        if not self.ready:
            return np.ones(len(texts)), sizes, sizes
        logit = marginals(self.line_logits(x), self.move, sizes)[0]
        good = np.add.reduceat((logit >= 0).astype(np.int64), np.cumsum(sizes) - sizes)
        return _sigmoid(self.curve[0] * self._raw(weight, sizes, logit) + self.curve[1]), sizes, good

    def lines(self, text: bytes) -> np.ndarray:
        """The probability of each line of being good."""
        x, _, sizes = line_features([text])
        return _sigmoid(marginals(self.line_logits(x), self.move, sizes)[0]) if self.ready else np.ones(len(x))


def train(docs: DataFrame, labels: DataFrame, *, usable=None, sample: int = SAMPLE, lines: int = LINES) -> Model:
    """documents (doc_id, text) and labels (doc_id, quality) -> model, from at most `sample` documents for which `usable` (a condition on doc_id) holds, whole ones of at most `lines` lines together.

    Several labels of a document: the mean, good from one half. Null labels and ids are passed over.
    """
    bounded_batches(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "good")
    t = fresh(docs.columns, "text")[0]
    rows = docs.select("doc_id", F.col("text").alias(t)).join(F.broadcast(taken), F.col("doc_id") == F.col("id")).select("id", "good", t)
    n_lines = F.coalesce(F.length(t) - F.length(F.translate(t, "\n", "")), F.lit(0)) + 1
    fits, total = [], 0
    for r in rows.groupBy("id").agg(F.sum(n_lines).alias("n")).orderBy(F.xxhash64("id"), "id").collect():  # at most `sample` rows
        if total + r.n <= lines:
            fits.append((r.id,))
            total += r.n
    kept = docs.sparkSession.createDataFrame(fits, docs.select(F.col("doc_id").alias("kept")).schema)
    rows = rows.join(F.broadcast(kept), F.col("id") == F.col("kept"), "left_semi")

    def featured(batches):
        for b, texts in steps(batches, t):
            x, weight, sizes = line_features(texts)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            name = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").cast(pa.string()), b.column("good"), pa.array(name), pa.ListArray.from_arrays(pa.array(ends), pa.array(weight.astype(np.int64))), pa.ListArray.from_arrays(pa.array(ends * OWN), pa.array(x[:, :OWN].astype(np.float32).ravel()))],
                ["id", "good", "name", "weight", "x"],
            )

    # A row a document, and only what is a line's own: neighbours' features are put beside it on the driver.
    got = rows.mapInArrow(featured, "id string, good int, name long, weight array<long>, x array<float>").toArrow()
    if not got.num_rows:
        return Model()
    got = got.sort_by([("id", "ascending"), ("name", "ascending")])  # one sum order, whatever came first
    flat = lambda c: pc.list_flatten(got.column(c).combine_chunks()).to_numpy()
    sizes, weight, good = pc.list_value_length(got.column("weight")).to_numpy().astype(np.int64), flat("weight").copy(), got.column("good").to_numpy().copy()
    x = beside(flat("x").reshape(-1, OWN), sizes)
    del got
    pa.default_memory_pool().release_unused()
    return Model(x, weight, sizes, good)


def scored(docs: DataFrame, model: Model, column: str = "score", counts: tuple[str, ...] = ()) -> DataFrame:
    """All columns of documents and the score of each whole text, 0 to 1; null text is empty, one empty line. counts: names for the numbers of lines and of good lines."""
    bounded_batches(docs.sparkSession)
    t = named(docs, "text")
    more = [T.StructField(column, T.DoubleType()), *[T.StructField(c, T.LongType()) for c in counts]]
    out = T.StructType([f for f in docs.schema if f.name.lower() not in {m.name.lower() for m in more}] + more)
    names = [f.name for f in out][: -len(more)]

    def run(batches):
        for b, texts in steps(batches, t):
            made = model.score(texts)[: len(more)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(m) for m in made]], out.names)

    return docs.mapInArrow(run, out)


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, table(spark, sf_dir, "labels"), usable=rest != 0)
    held_out = F.coalesce(rest == 0, F.lit(False)).alias("held_out")
    return scored(docs, model, counts=("n_lines", "n_good")).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_good")
