"""Substring dedup: words covered by a window of WINDOW words that also starts elsewhere are removed, by suffix automata.

A suffix automaton over the whole corpus, or each document against automata of all others, would not scale. Winnowing
sends each window to the one place where its repeats must be: every window is represented by its anchor, the smallest
hash among its k-word grams (the last of equal ones), so equal windows have equal anchors. Neighbouring windows with one
anchor form a fragment; each window of the corpus is in exactly one fragment.

1. Anchors that stand at one place only have no repeated window: nearly all of the corpus leaves here.
2. Of all other anchors each distinct fragment goes once, as words, with its number of occurrences, to its anchor's shard. A
   task builds the suffix automaton of a reference shard (bounded in words), streams the shard's fragments through it, and takes
   the matching statistics: the longest suffix at each word that occurs twice. Where that is WINDOW words or more, they are
   covered. What is covered of a fragment is joined to all of its occurrences.
3. Anchors with over MOST distinct fragments (a passage that many texts share, among different words) are dealt out again: the
   distinct fragments are texts themselves, cut by longer anchors (GRAMS), in the end by whole windows, and go the same way. So
   no group outgrows a shard.

The automata decide, over the words themselves. Hashes of 64 bits name texts, anchors and fragments; fragments are the same if
both their hash and their anchor's are. A text's name is salted by its doc_id, so that copies of one page are spread. Automata are
built where their shard's fragments are, not sent to every executor: a broadcast of all shards would read the whole corpus once
for each of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowops import after, bounds, hashed_words, hashed_windows, runs, steps
from siltstone.llm.common import fresh, removed, table, written

WINDOW, GRAMS, MOST, SHARD, SALTS = 35, (10, 20, 30), 2000, 100_000, 64


def _last_smallest(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w neighbours the place of its smallest value, the last of equal ones."""
    at, have = np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        right = x[step:] <= x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def fragments(words: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, fragment (hashes), owner (which text), start, end (words in the text) of each fragment of texts whose words stand in a row."""
    gram = min(gram, window)
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams, windows = hashed_windows(words, gram), hashed_windows(words, window)
    anchor_at = _last_smallest(grams, window - gram + 1)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor_at)]
    s = np.flatnonzero(np.arange(len(anchor_at)) + window <= (first + sizes)[owner])
    anchor_at, owner = anchor_at[s], owner[s]
    cut = bounds(anchor_at, owner)
    starts, ends = s[cut[:-1]], s[cut[1:] - 1] + window
    at, owner = anchor_at[cut[:-1]], owner[cut[:-1]]
    # A fragment has under two windows' words: its first and last window and its length say all of it.
    frag = after(after(windows[starts], windows[ends - window]), (ends - starts).astype(np.uint64))
    return grams[at], frag, owner, starts - first[owner], ends - first[owner]


class SuffixAutomaton:
    """Of several sequences, with the number of times that each state's strings occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence, times: int = 1) -> None:
        last = 0
        nxt, link, length, count = self.next, self.link, self.length, self.count
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                new, p = len(nxt), last
                nxt.append({})
                length.append(length[last] + 1)
                count.append(0)
                link.append(0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            count[last] += times

    def finish(self) -> None:
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def statistics(self, sequence, times: int = 2):
        """For each place the length of the longest suffix there that occurs `times` times."""
        v = n = 0
        for c in sequence:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            while v and self.count[v] < times:
                v = self.link[v]
                n = self.length[v]
            yield n


def _covered(window: int, shard: int):
    """Distinct fragments by anchor (anchor, frag, n, ..., words) -> anchor, frag, begin, stop of the spans that repeated windows cover."""

    def shard_spans(rows):
        automaton, numbers = SuffixAutomaton(), {}
        told = [(a, f, n, [numbers.setdefault(w, len(numbers)) for w in words.split(b" ")]) for a, f, n, words in rows]
        for _, _, n, words in told:
            automaton.add(words, n)
        automaton.finish()
        for a, f, _, words in told:
            begin = end = -1
            for i, m in enumerate(automaton.statistics(words)):
                if m >= window:
                    if end < i - m + 1:
                        if end > 0:
                            yield a, f, begin, end
                        begin = i - m + 1
                    end = i + 1
            if end > 0:
                yield a, f, begin, end

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), (), ()), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["anchor", "frag", "begin", "stop"])

    def run(batches):
        held, size, before = [], 0, None
        for t in runs(batches, ["anchor"]):
            for row in zip(*[t.column(c).to_pylist() for c in ("anchor", "frag", "n", "words")]):
                if size > shard and row[0] != before[0]:
                    yield batch(list(shard_spans(held)))
                    held, size = [], 0
                if before is None or row[:2] != before[:2]:  # copies of a text bring the same fragment
                    held.append(row)
                    size += row[3].count(b" ") + 1
                before = row
        yield batch(list(shard_spans(held)))

    return run


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, the text and its name."""
    return docs.select("doc_id", F.col("text").alias(text), F.xxhash64("text", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).alias(key))


def _batch(columns, kinds: str) -> pa.RecordBatch:
    """A batch of the columns named and typed in `kinds`."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [k.split() for k in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


def _same(*columns: str):
    """Equal to the columns of the same names with a 2 behind."""
    return [F.col(c) == F.col(f"{c}2") for c in columns]


def _spans(texts: DataFrame, grams: tuple[int, ...], window: int, most: int, shard: int) -> DataFrame:
    """texts (key, n, text; n: how often the text occurs, 2 for more) -> key, s, e: word spans that repeated windows cover, distinct and written."""
    spark, gram, last = texts.sparkSession, grams[0], len(grams) == 1
    placed_as, worded_as = "anchor long, frag long, key long, n int, s int, e int", "anchor long, frag long, n int, many int, words binary"

    def anchored(batches):
        for b, x in steps(batches, "text"):
            anchor, frag, owner, s, e = fragments(*hashed_words(x), window, gram)
            yield _batch([anchor.view(np.int64), frag.view(np.int64), b.column("key").to_numpy()[owner], b.column("n").to_numpy()[owner], s.astype(np.int32), e.astype(np.int32)], placed_as)

    def worded(batches):
        for b, x in steps(batches, "text"):
            out = []
            for text, wanted in zip(x, b.column("asked").to_pylist()):
                words = text.split()
                out += [(w["anchor"], w["frag"], w["n"], w["many"], b" ".join(words[w["s"] : w["e"]])) for w in wanted]
            yield _batch(zip(*out) if out else [()] * 5, worded_as)

    placed = written(texts.mapInArrow(anchored, placed_as), "fragments")
    distinct = placed.groupBy("anchor", "frag").agg(F.sum("n").alias("times"))
    often = distinct.groupBy("anchor").agg(F.sum("times").alias("total"), F.count("*").alias("frags")).where("total > 1").select(F.col("anchor").alias("anchor2"), "frags")
    met = distinct.join(often, _same("anchor")).select("anchor2", F.col("frag").alias("frag2"), F.least("times", F.lit(2)).cast("int").alias("times"), "frags")
    found = written(placed.join(met, _same("anchor", "frag")).select("anchor", "frag", "key", "s", "e", "times", "frags"), "repeated")
    removed(spark, placed)

    # One occurrence of each distinct fragment; the words come from its text.
    asked = found.groupBy("anchor", "frag", "times", "frags").agg(F.min(F.struct("key", "s", "e")).alias("at"))
    asked = asked.groupBy(F.col("at.key").alias("key2")).agg(F.collect_list(F.struct("anchor", "frag", F.col("times").alias("n"), (F.lit(not last) & (F.col("frags") > most)).cast("int").alias("many"), "at.s", "at.e")).alias("asked"))
    parts = texts.join(asked, _same("key")).select("text", "asked").mapInArrow(worded, worded_as)

    # Of anchors with too many fragments these are texts again, cut by longer anchors; in the end an anchor is a whole window and has one.
    deep = None
    if not last and (found.agg(F.max("frags")).first()[0] or 0) > most:
        parts = written(parts, "parts")
        again = parts.where("many = 1").dropDuplicates(["anchor", "frag"]).select(F.xxhash64("anchor", "frag").alias("key"), "n", F.col("words").cast("string").alias("text"))
        deep = _spans(again, grams[1:], window, most, shard).select(F.col("key").alias("id"), F.col("s").alias("begin"), F.col("e").alias("stop"))
        parts = parts.where("many = 0")
    spans = parts.repartition("anchor").sortWithinPartitions("anchor", "frag").mapInArrow(_covered(window, shard), "anchor long, frag long, begin int, stop int")
    spans = spans.select(F.xxhash64("anchor", "frag").alias("id"), "begin", "stop")
    spans = spans.union(deep) if deep is not None else spans
    out = found.join(spans, F.xxhash64("anchor", "frag") == F.col("id")).select("key", (F.col("s") + F.col("begin")).alias("s"), (F.col("s") + F.col("stop")).alias("e")).distinct()
    out = written(out, "covered")
    removed(spark, found)
    return out


def repeats(docs: DataFrame, *, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """documents (doc_id, text) -> key (the name of a text), spans (array of word spans s, e): what repeated windows cover; texts without any have no row."""
    texts = _named(docs, "text", "key").where("text is not null").select("key", F.lit(1).alias("n"), "text")
    return _spans(texts, (*grams, window), window, most, shard).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def without_repeats(docs: DataFrame, *, window: int = WINDOW, **limits) -> DataFrame:
    """documents (doc_id, text; other columns are ignored) -> doc_id, n_words, n_removed, kept_sha256, kept (words joined by one space); a row a document.

    Null text has no words. Texts shorter than the window keep all words. Repeated rows are repeats of each other.
    Null ids are rows like any other; an empty table gives none.
    """
    t, k = fresh(docs.columns, "text", "key")
    rows = _named(docs, t, k).join(repeats(docs, window=window, **limits), F.col(k) == F.col("key"), "left").select("doc_id", t, "spans")

    def cut(batches):
        for b, x in steps(batches, t):
            n, removed, kept = [], [], []
            for text, spans in zip(x, b.column("spans").to_pylist()):
                words = text.split()
                n.append(len(words))
                left, at = [], 0
                for s, e in sorted((p["s"], p["e"]) for p in spans or ()):
                    left += words[at:s]
                    at = max(at, e)
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = docs.select("doc_id").schema.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType()).add("kept", T.StringType())
    return rows.mapInArrow(cut, out)


def op9_substrings(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: The same in DuckDB, with every window spelled out.
SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT rid, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS g FROM docs, unnest(range(1, len(ws) - {WINDOW - 2})) t(s) WHERE len(ws) >= {WINDOW}),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, s + k AS p FROM twice, range(0, {WINDOW}) r(k)),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM docs),
kept AS (
  SELECT w.rid, count(g.p) AS n_removed, string_agg(w.word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS said
  FROM words w LEFT JOIN gone g ON g.rid = w.rid AND g.p = w.p GROUP BY w.rid
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.said, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.rid = d.rid
"""
