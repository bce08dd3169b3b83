"""Target-distribution importance resampling over hashed word runs, in two Arrow passes.

Features of a text are its runs of 1 to RUN words, joined by one space, repeats counted; each falls into one of BUCKETS buckets
by its CRC-32. First pass: a task adds np.bincount vectors of its batches and gives one vector of BUCKETS counts;
treeReduce merges them, so the driver meets a few vectors only. Once for the documents, once for the target texts. A bucket's
gain is the floored, smoothed log ratio of the two distributions. Second pass: gains, a broadcast vector of BUCKETS numbers,
are gathered by bucket and summed by document as bincount weights.

CRC-32 is linear: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b), where the shift by n bytes is four lookups. So words are hashed
once, all of a batch together, and runs of words come from their words' values; no run is ever built as bytes.

The draw adds Gumbel noise from the id's hash and takes the highest scores. Scores are dealt by ranges and numbered within them;
a rank is the number within the range after the counts of the ranges before, so no task sorts the table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.arrowops import steps
from siltstone.llm.common import bounded_batches, fresh, table, written

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words up to so many bytes are hashed together and shifted by one table; longer ones one by one, in powers of two.
LONG = 64

_ONE = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
#: Register after one byte, of which the low eight bits were i: the linear part of the table of CRC-32.
_STEP = _ONE[np.arange(256) ^ 255] ^ np.uint32(zlib.crc32(b"\xff"))


def _one_byte(x: np.ndarray) -> np.ndarray:
    return _STEP[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _looked_up(tables: np.ndarray, at, x: np.ndarray) -> np.ndarray:
    """tables[n, j, v]: what the value v of byte j becomes by the n-th shift; `at` picks the shift of each x."""
    flat, at = tables.reshape(-1), np.asarray(at, np.int64) << 10
    out = flat[at + (x & np.uint32(255))]
    for j in (1, 2, 3):
        out ^= flat[at + (256 * j) + ((x >> np.uint32(8 * j)) & np.uint32(255))]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Shifts by 0 .. LONG bytes, and by powers of two."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    each = [unit]
    for _ in range(LONG):
        each.append(_one_byte(each[-1]))
    power = [each[1]]
    for _ in range(31):
        power.append(_looked_up(power[-1], 0, power[-1]))
    return np.stack(each), np.stack(power)


_SHIFT, _POWER = _tables()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 as it enters that of a longer string with `size` more bytes."""
    out = _looked_up(_SHIFT, np.minimum(size, LONG), crc)
    far = np.flatnonzero(size > LONG)
    if len(far):
        x, rest = crc[far], size[far]
        for k in range(int(rest.max()).bit_length()):
            on = np.flatnonzero(rest >> k & 1)
            x[on] = _looked_up(_POWER[k], 0, x[on])
        out[far] = x
    return out


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, all spans one byte further in each step."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    at, sizes = starts[order], size[order]
    longer = int(np.searchsorted(-sizes, -LONG, "left"))  # how many are longer than LONG
    x = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(min(size.max(initial=0), LONG))):
        n = int(np.searchsorted(-np.minimum(sizes, LONG + 1), -j, "left"))
        x[longer:n] = _STEP[(x[longer:n] ^ data[at[longer:n] + j]) & np.uint32(255)] ^ (x[longer:n] >> np.uint32(8))
    out = np.empty_like(x)
    out[order] = x ^ np.uint32(0xFFFFFFFF)
    whole = memoryview(np.ascontiguousarray(data))
    for i in order[:longer].tolist():
        out[i] = zlib.crc32(whole[starts[i] : ends[i]])
    return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def run_buckets(texts: list[bytes], buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text (ASCII lower case; letters, digits and all that is not ASCII), and for each length of run the bucket and the text of every run."""
    joined = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    word = np.concatenate(([False], _LETTER[joined], [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    sizes = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    owner, crc, size = np.repeat(np.arange(len(sizes)), sizes), crcs(joined, starts, ends), ends - starts
    spaced = crc ^ shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size)
    found, of = [(crc % np.uint32(buckets)).astype(np.int64)], [owner]
    so_far = crc
    for n in range(1, run):
        so_far = shifted(so_far[:-1], size[n:] + 1) ^ spaced[n:] if len(crc) > n else crc[:0]
        whole = np.flatnonzero(owner[n:] == owner[: len(owner) - n]) if len(crc) > n else owner[:0]
        found.append((so_far[whole] % np.uint32(buckets)).astype(np.int64))
        of.append(owner[n:][whole])
    return sizes, found, of


def bucket_counts(texts: DataFrame, column: str = "text", *, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many runs of all texts fall into each bucket: a vector of bincounts for each task, merged by treeReduce."""

    def counts(batches):
        total = np.zeros(buckets, np.int64)
        for _, part in steps(batches, "text"):
            for found in run_buckets(part, buckets, run)[1]:
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()])], ["counts"])

    vectors = texts.select(F.col(column).cast("string").alias("text")).mapInArrow(counts, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], "<i8"))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, depth=3)


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares of target and raw) of each bucket, in doubles."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    n = float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, *, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each whole text: the sum of the gains of its runs."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64)), len(gains)
    t, = fresh(docs.columns, "text")
    rows = docs.select("doc_id", F.col("text").alias(t))

    def sums(batches):
        gain = held.value
        for b, part in steps(batches, t):
            words, found, of = run_buckets(part, buckets, run)
            weight = sum(np.bincount(o, gain[f], len(part)) for f, o in zip(found, of))
            features = sum(np.bincount(o, minlength=len(part)) for o in of)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(sums, rows.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def noise(doc_id, seed: int = SEED):
    """1000 times a Gumbel draw of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, *, seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document, by the target texts' distribution."""
    gains = gains_of(bucket_counts(docs, buckets=buckets, run=run), bucket_counts(target, buckets=buckets, run=run))
    return weighed(docs, gains, run=run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _ordered():
    return [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """documents (doc_id, text), target (text); other columns are ignored -> doc_id, n_features, weight, score, rank; a row a document.

    Drawn are floor(percent * N / 100) of the N documents with `least_words` words or more: the highest scores, ties to the smaller
    id. rank: from 1 among the drawn, null else. Null and empty texts have no features and weight 0; a null id counts as an empty
    one in the noise and comes last in ties. Repeated rows are rows; those equal in all are interchangeable. An empty target
    leaves all to the smoothing; empty documents give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = scored(docs, target, seed=seed, buckets=buckets, run=run).withColumn("eligible", F.col("n_words") >= least_words)
    # The number within a range lies in the low 33 bits, the range above.
    dealt = written(rows.repartitionByRange(*_ordered()).sortWithinPartitions(*_ordered()).withColumn("place", F.monotonically_increasing_id()), "ranks")
    ranges = dealt.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("long")).alias("eligible_n"))
    whole = W.partitionBy(F.lit(0))  # a row a range
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.expr(f"{int(percent)} * sum(eligible_n) over (partition by 0) div 100").alias("drawn"))
    at = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.join(F.broadcast(ranges), F.shiftright("place", 33) == F.col("range"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(at <= F.col("drawn"), at).cast("long").alias("rank"))


def op12_resampling(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FEATURES = r"""
  SELECT {id} AS id, unnest(list_concat(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]), [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])) AS f
  FROM (SELECT {id}, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM {table})
"""

#: The same in DuckDB, with CRC-32 by its table: a fold over the bytes of each distinct feature.
SQL = rf"""
WITH crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
df AS MATERIALIZED ({_FEATURES.format(id="doc_id", table="documents")}),
bf AS MATERIALIZED ({_FEATURES.format(id="item_id", table="benchmark")}),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce([('0x' || h[2 * k + 1:2 * k + 2])::BIGINT FOR k IN range(len(h) // 2)], lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)), crc_table
),
s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT i AS bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
),
weights AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= {3 * LEAST_WORDS - 3} DESC, score DESC, doc_id) AS r, {PERCENT} * (count(*) FILTER (WHERE n_features >= {3 * LEAST_WORDS - 3}) OVER ()) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM placed
"""
