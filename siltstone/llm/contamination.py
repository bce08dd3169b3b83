"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document is contaminated by an item if one of its windows of as many words as the item has (or the whole document,
if it is shorter) has a weighted similarity of at least `least` with it: shared SHINGLE-word shingles, repeats counted,
over all of both. Every window gets a 128-bit SimHash of its weighted shingles, unless a lossless bound already excludes
it: two multisets of m and n shingles at similarity s share at least (m + n) s / (1 + s), so a window with fewer shingles
of any item of its size cannot pass. The 8 blocks of 16 bits of a fingerprint are looked up within RADIUS // 8 bits in
the items' block tables, which finds all items within RADIUS; those are compared exactly, word by word: hashes propose only.

Shingles at similarity 0.8 differ in about 15 % of the bits, 19 of 128 with a spread of 4; unrelated ones in 64 with a
spread of 6. RADIUS 40 is five spreads from either.

The benchmark goes to the workers in parts of at most PART bytes of text, so no broadcast grows with it. Of several parts each is
one pass whose hits are written before the next part is read; the driver holds one at a time.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowops import bounds, hashed_spans, hashed_windows, mixed, placed_words, steps
from siltstone.llm.common import bounded_batches, fresh, named, table, written

SHINGLE, LEAST, RADIUS, PART = 5, 0.8, 40, 16_000_000
_NEAR = {b: np.array([sum(1 << i for i in c) for n in range(b + 1) for c in combinations(range(16), n)], np.int64) for b in range(6)}


def simhash128(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints (2 x 64 bits) of runs of shingle hashes that stand in a row; a bit is 1 if set in over half, repeats counted."""
    both = np.stack((shingles, mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))), 1)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros((len(sizes), 128), bool)
    for i in range(0, len(sizes), 256):
        j = min(i + 256, len(sizes))
        bits = np.unpackbits(both[at[i] : at[j]].view(np.uint8), axis=1, bitorder="little")
        out[i:j] = np.add.reduceat(bits, at[i:j] - at[i], axis=0, dtype=np.int32) * 2 > sizes[i:j, None]
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def worded(words: list[bytes], w: int) -> Counter:
    """The shingles of w words and how often each occurs."""
    return Counter(zip(*[words[i:] for i in range(w)]))


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Index:
    """Benchmark items, with block tables over their fingerprints, and for each width of shingle which numbers of words its items have."""

    #: Items whose shingles are held as words; made when a window comes near one.
    HELD = 1000

    def __init__(self, items: list[tuple[object, str | None]], k: int = SHINGLE, least: float = LEAST, radius: int = RADIUS):
        self.k, self.least, self.radius = k, least, radius
        texts = [(t or "").encode().lower() for _, t in items]
        joined, starts, ends, sizes = placed_words(texts)
        hashes, first = hashed_spans(joined, starts, ends), np.cumsum(sizes) - sizes
        self.items, prints, shingles = [], [], {}
        for (i, _), text, at, n in zip(items, texts, first.tolist(), sizes.tolist()):
            if n:
                w = min(k, n)
                h = hashed_windows(hashes[at : at + n], w)
                prints.append(simhash128(h, np.array([len(h)]))[0])
                shingles.setdefault(w, []).append((n, h))
                self.items.append((i, n, text))
        self.prints, self.counts = np.array(prints, np.uint64).reshape(-1, 2), {}
        self.own = {}
        for x, (_, n, _) in enumerate(self.items):
            self.own.setdefault(n, set()).add(x)
        #: width -> (a table of the lowest bits, the shingles, where their lengths begin, the lengths): in order of shingle, each length once.
        self.known = {}
        for w, found in shingles.items():
            value = np.concatenate([h for _, h in found])
            length = np.repeat(np.array([n for n, _ in found]), [len(h) for _, h in found])
            order = np.lexsort((length, value))
            value, length = value[order], length[order]
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (length[1:] != length[:-1])))
            value, length = value[new], length[new]
            begin = bounds(value)
            table = np.zeros(1 << 20, bool)
            table[value & np.uint64((1 << 20) - 1)] = True
            self.known[w] = (table, value[begin[:-1]], begin, length)
        self.blocks = []
        for b in range(8):
            value = (self.prints[:, b // 4] >> np.uint64(16 * (b % 4))).astype(np.int64) & 0xFFFF
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.searchsorted(value[order], np.arange(65537)), order))

    def worded(self, item: int) -> Counter:
        """The item's shingles as words."""
        if item not in self.counts:
            if len(self.counts) >= self.HELD:
                self.counts.clear()
            _, n, text = self.items[item]
            self.counts[item] = worded(text.split(), min(self.k, n))
        return self.counts[item]

    def members(self, shingles: np.ndarray, w: int) -> dict[int, np.ndarray]:
        """For each number of words the places, ascending, whose shingle some item of so many words has."""
        table, value, begin, length = self.known[w]
        at = np.flatnonzero(table[shingles & np.uint64((1 << 20) - 1)])
        found = np.minimum(np.searchsorted(value, shingles[at]), len(value) - 1)
        there = value[found] == shingles[at]
        at, found = at[there], found[there]
        n = begin[found + 1] - begin[found]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        sizes, at = length[np.repeat(begin[found], n) + place], np.repeat(at, n)
        order = np.argsort(sizes, kind="stable")
        cut = bounds(sizes[order])
        return {int(sizes[order[i]]): at[order[i:j]] for i, j in zip(cut[:-1], cut[1:])}

    def within(self, fp: np.ndarray) -> np.ndarray:
        """Numbers of all items within the radius of a fingerprint, by the multi-index: one block is within radius // 8 bits."""
        met = []
        for b, (at, order) in enumerate(self.blocks):
            near = (int(fp[b // 4]) >> 16 * (b % 4) & 0xFFFF) ^ _NEAR[self.radius // 8]
            full = near[at[near + 1] > at[near]]
            met += [order[at[v] : at[v + 1]] for v in full]
        met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        return met[np.bitwise_count(self.prints[met] ^ fp).sum(1) <= self.radius]

    def hits(self, texts: list[bytes]) -> list[dict]:
        """For each text: item -> (similarity, first word of the best window, words of it)."""
        out: list[dict] = [{} for _ in texts]
        if not self.items:
            return out
        placed = joined, starts, ends, sizes = placed_words([t.lower() for t in texts])
        words, first = hashed_spans(joined, starts, ends), np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        shingles = {w: hashed_windows(words, w) for w in self.known}
        memory = {}
        for w, n, at in [(w, n, at) for w in self.known for n, at in self.members(shingles[w], w).items()]:
            at = at[at + w <= (first + sizes)[owner[at]]]
            if not len(at):
                continue
            own = self.own[n]
            of = owner[at]
            full = sizes[of] >= n
            m = n - w + 1
            need = int(np.ceil(2 * m * self.least / (1 + self.least) - 1e-9))
            p = at[full]
            if len(p) >= need:  # windows of n words with enough members, in one text
                a, b = p[: len(p) - need + 1], p[need - 1 :]
                ok = (b - a < m) & (owner[a] == owner[b])
                lo, hi = np.maximum(b[ok] - m + 1, first[owner[a[ok]]]), np.minimum(a[ok], (first + sizes)[owner[a[ok]]] - n)
                begin = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo.tolist(), hi.tolist())] or [np.zeros(0, np.int64)]))
                self._verify(out, shingles[w], begin, np.full(len(begin), m), own, owner, placed, w, memory)
            short = np.unique(of[~full])
            short = short[sizes[short] >= w]
            if len(short):
                self._verify(out, shingles[w], first[short], sizes[short] - w + 1, own, owner, placed, w, memory)
        return out

    def _verify(self, out, shingles, begin, counts, own, owner, placed, w, memory) -> None:
        joined, starts, ends, sizes = placed
        first = np.cumsum(sizes) - sizes
        for i in range(0, len(begin), 256):
            s, c = begin[i : i + 256], counts[i : i + 256]
            runs = [shingles[x : x + n] for x, n in zip(s.tolist(), c.tolist())]
            for x, n, fp in zip(s.tolist(), c.tolist(), simhash128(np.concatenate(runs), c)):
                key = fp.tobytes()
                if key not in memory:
                    memory[key] = self.within(fp).tolist()
                near = [item for item in memory[key] if item in own]
                if near:
                    window = worded(joined[starts[x] : ends[x + n + w - 2]].tobytes().split(), w)
                    doc = int(owner[x])
                    for item in near:
                        score, name = similarity(window, self.worded(item)), self.items[item][0]
                        if score >= self.least and score > out[doc].get(name, (0,))[0]:
                            out[doc][name] = (score, x - int(first[doc]), n + w - 1)


def _parts(benchmark: DataFrame, size: int):
    """Items in parts of bounded size, in order of id, one after the other."""
    part, held = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if held and held + len(r.text or "") > size:
            yield part
            part, held = [], 0
        part.append((r.item_id, r.text))
        held += len(r.text or "") + 64
    yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, *, part: int = PART, **how) -> DataFrame:
    """documents (doc_id, text), benchmark (item_id, text); other columns are ignored -> doc_id, item_id, similarity, start, n_words; a row a pair.

    start and n_words give the best window, the first of equal ones. Null and empty texts and items have no window; an
    item of fewer words than a shingle is one shingle. Null ids are ids; repeated documents have rows each; items
    with one id count once, by the better. Empty tables give none.
    """
    t = fresh(docs.columns, "text")[0]
    rows = docs.select("doc_id", F.col("text").alias(t))
    item = benchmark.schema["item_id"].dataType
    schema = docs.select("doc_id").schema.add("item_id", item).add("similarity", T.DoubleType()).add("start", T.LongType()).add("n_words", T.LongType())

    def found(items):
        def run(batches):
            index = Index(items, **how)
            for b, texts in steps(batches, t):
                got = [(d, i, *x) for d, hit in enumerate(index.hits(texts)) for i, x in hit.items()]
                if got:
                    d, i, s, at, n = map(list, zip(*got))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(i), pa.array(s), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "similarity", "start", "n_words"])

        return rows.mapInArrow(run, schema)

    out = before = None
    for items in _parts(benchmark, part):
        if before is not None:
            before = written(before, "hits")
            out = before if out is None else out.union(before)
        before = found(items)
    return before if out is None else out.union(before)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, part: int = PART, **how) -> DataFrame:
    """The documents that no item contaminates, all their columns. Null and empty texts and repeated rows stay; without items all do; an empty table gives none."""
    bounded_batches(docs.sparkSession)
    names, t, passed = docs.columns, named(docs, "text"), 0
    for items in _parts(benchmark, part):
        if passed:
            docs = written(docs, "clean")
        passed += 1

        def run(batches, items=items):
            index = Index(items, **how)
            for b, texts in steps(batches, t):
                clean = pa.array([not h for h in index.hits(texts)])
                yield pa.RecordBatch.from_arrays([b.column(n).filter(clean) for n in names], names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB for items of SHINGLE words or more: all windows that share a shingle with an item, counted out.
SQL = rf"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
iw AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM benchmark),
ds AS (SELECT doc_id, len(ws) AS n, s - 1 AS p, array_to_string(ws[s:s + {SHINGLE - 1}], ' ') AS g FROM dw, unnest(range(1, len(ws) - {SHINGLE - 2})) t(s) WHERE len(ws) >= {SHINGLE}),
ins AS (SELECT item_id, n, g, count(*) AS c FROM (SELECT item_id, len(ws) AS n, array_to_string(ws[s:s + {SHINGLE - 1}], ' ') AS g FROM iw, unnest(range(1, len(ws) - {SHINGLE - 2})) t(s) WHERE len(ws) >= {SHINGLE}) GROUP BY ALL),
met AS (SELECT ds.doc_id, ds.n AS dn, ds.p, ds.g, ins.item_id, ins.n AS n, ins.c FROM ds JOIN ins ON ins.g = ds.g),
spans AS (
  SELECT DISTINCT doc_id, item_id, dn, n, s AS start, least(n, dn) - {SHINGLE - 1} AS m
  FROM met, unnest(range(greatest(0, p - least(n, dn) + {SHINGLE}), least(p, dn - least(n, dn)) + 1)) t(s)
),
shared AS (
  SELECT s.doc_id, s.item_id, s.start, s.m, s.n, s.dn, met.g, least(count(*), any_value(met.c)) AS k
  FROM spans s JOIN met ON met.doc_id = s.doc_id AND met.item_id = s.item_id AND met.p >= s.start AND met.p < s.start + s.m GROUP BY ALL
),
scored AS (SELECT doc_id, item_id, start, least(n, dn) AS n_words, sum(k)::DOUBLE / (m + n - {SHINGLE - 1} - sum(k))::DOUBLE AS similarity FROM (SELECT doc_id, item_id, start, m, n, dn, k FROM shared) GROUP BY doc_id, item_id, start, m, n, dn)
SELECT doc_id, item_id, similarity, start, n_words FROM scored WHERE similarity >= {LEAST}::DOUBLE
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
