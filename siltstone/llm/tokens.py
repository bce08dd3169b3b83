"""Token ids in Parquet: list columns that can be read selectively.

Layout: one row per document, ascending by doc_id over all files; `doc_id`, `bucket`, `n_tokens` delta-encoded,
`ids` a list column with a dictionary (a public vocabulary fits one dictionary page), zstd pages. Row groups and
pages are small and page indexes are written, so a reader of a few documents opens few pages, and a reader of
counts never opens the ids. `bucket` is the number of the range of doc_ids, so that document starts are two
small prefix sums over counts alone.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowops import hashed_spans, steps
from siltstone.llm.common import bounded_batches, fresh, new_path, table

END_ID = 2
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then the same of the next."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


#: Words that a worker keeps with their ids before it drops those met once; bounds memory, changes no result.
CACHE = 250_000
#: Bytes of new words that go through the library in one text.
PIECE = 16_000
_encoders: dict = {}
#: Bytes beside which a space may stand in white space: ASCII space and controls, and the first bytes of all wider spaces.
_UNSAFE = np.zeros(256, bool)
_UNSAFE[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array; start and end of each word, a word having the space or line feed before it; and how many words each text has.

    Cuts are before each single space or line feed that stands between two texts without white space. A byte-level
    pre-tokenizer cuts there too, so words encode apart.
    """
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at = np.flatnonzero((joined == 32) | (joined == 10))
    at = at[(at > 2) & ~_UNSAFE[joined[np.minimum(at + 1, len(joined) - 1)]]]
    one, two, three = joined[at - 1], joined[at - 2], joined[at - 3]
    wide = (one >= 0x80) & (one < 0xC0) & ((two == 0xC2) | ((two < 0xC0) & (three >= 0xE1) & (three <= 0xE3)))
    starts = np.sort(np.concatenate((at[~wide & ~_UNSAFE[one]], edges[:-1])), kind="stable")
    ends = np.append(starts[1:], len(joined))
    last = np.searchsorted(starts, edges[1:]) - 1
    ends[last] = edges[1:] - 1
    counts = np.diff(last, prepend=-1)
    full = ends > starts
    counts -= np.bincount(np.repeat(np.arange(len(texts)), counts)[~full], minlength=len(texts))
    return joined, starts[full], ends[full], counts


class Numbers:
    """64-bit hash -> number, an open-addressing table in NumPy."""

    def __init__(self, bits: int = 20):
        self.mask, self.keys, self.values, self.n = np.uint64((1 << bits) - 1), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def get(self, h: np.ndarray) -> np.ndarray:
        """Numbers, or -1."""
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & self.mask
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def put(self, h: np.ndarray) -> None:
        """Numbers distinct new hashes in their order."""
        left, slot = np.arange(len(h)), h & self.mask
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = h[left[won]], self.n + left[won]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        self.n += len(h)


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, with a table of the words met before.

    Words are looked up by 64-bit hashes and compared with the table's bytes; a step with a word that has another's hash goes
    through the library as it is. Special tokens in a text are ids of their own, as the library has them.

    New words go through the tokenizer one behind the other, as texts of PIECE bytes whose cuts by `words_of` are the words' edges. The bytes that
    each id stands for say which ids are whose. Words that this leaves open are encoded one by one: letters alone, with one mark of
    `MARKS` or without, by the library's BPE model, since the pre-tokenizer would cut them into just these parts; others by the whole tokenizer.
    """

    MARKS = b",.;:!?"

    def __init__(self, vocabulary: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        self.model = self.tokenizer.model
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.letters = str.maketrans({chr(b): chr(c) for b, c in shown.items()})  # bytes as the model's alphabet has them
        self.marks = {m: self.tokenizer.encode(chr(m), add_special_tokens=False).ids for m in self.MARKS}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        widths = {i: len(x) for x, i in vocab.items()} | {i: len(x.content.encode()) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.widths = np.zeros(max(widths) + 1, np.int64)
        self.widths[list(widths)] = list(widths.values())
        self.newline, self.none = self.tokenizer.encode("\n", add_special_tokens=False).ids, []
        self.hashes = np.zeros(0, np.uint64)
        self.reset(np.zeros(0, np.int64))

    def reset(self, kept: np.ndarray) -> None:
        """Keeps the words of these numbers only."""
        if len(self.hashes):
            lengths = np.diff(self.ends)[kept]
            self.pool, self.ends = self.pool[gathered(self.ends[kept], lengths)], np.concatenate(([0], np.cumsum(lengths)))
            lengths = np.diff(self.raw_ends)[kept]
            self.raw, self.raw_ends = self.raw[gathered(self.raw_ends[kept], lengths)], np.concatenate(([0], np.cumsum(lengths)))
        else:
            self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
            self.raw, self.raw_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.hashes, self.seen, self.numbers = self.hashes[kept], np.zeros(len(kept), np.int64), Numbers()
        self.numbers.put(self.hashes)

    def plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids])

    def ids_of(self, word: bytes) -> list[int]:
        tail = self.marks.get(word[-1], self.none)
        core = word if tail is self.none else word[:-1]
        head = self.none
        if core[:1] == b"\n":
            head, core = self.newline, core[1:]
        letters = core[1:] if core[:1] == b" " else core
        if letters.isalpha():
            core = core.decode().replace(" ", "\u0120")
        elif letters.decode("utf-8", "replace").isalpha():
            core = core.decode("latin-1").translate(self.letters)
        else:
            return self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return [*head, *[t.id for t in self.model.tokenize(core)], *tail]

    def new_words(self, joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words in a row, and how many each has."""
        blob = joined[gathered(starts, ends - starts)]
        edges = np.concatenate(([0], np.cumsum(ends - starts)))
        raw, cut = blob.tobytes(), np.zeros(len(blob) + 1, bool)
        cut[words_of([raw])[1]] = cut[[0, -1]] = True
        safe = edges[cut[edges]]
        pieces = np.unique(np.append(safe[np.searchsorted(safe, np.arange(0, len(blob), PIECE))], len(blob)))
        try:
            got = [np.array(self.tokenizer.encode_batch_fast([raw[i:j].decode()], add_special_tokens=False)[0].ids, np.int32) for i, j in zip(pieces[:-1].tolist(), pieces[1:].tolist())]
        except UnicodeDecodeError:
            got = []
        ids = np.concatenate(got) if got else np.zeros(0, np.int32)
        over = np.concatenate(([0], np.cumsum(self.widths[ids])))
        at = np.searchsorted(over, edges)
        clear = cut[edges] & (over[np.minimum(at, len(ids))] == edges) & (over[-1] == len(blob))
        known, sizes = clear[:-1] & clear[1:], np.diff(at)
        if known.all():
            return ids, sizes
        single = [self.ids_of(raw[edges[i] : edges[i + 1]]) for i in np.flatnonzero(~known).tolist()]
        before = at[:-1][known]
        sizes[~known] = [len(x) for x in single]
        place = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[gathered(place[known], sizes[known])] = ids[gathered(before, sizes[known])]
        out[gathered(place[~known], sizes[~known])] = np.fromiter(chain.from_iterable(single), np.int32)
        return out, sizes

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        joined, starts, ends, counts = words_of(texts)
        h = np.maximum(hashed_spans(joined, starts, ends), np.uint64(1))
        at = self.numbers.get(h)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh_hashes, first, which = np.unique(h[unknown], return_index=True, return_inverse=True)
            of = unknown[first]
            new, sizes = self.new_words(joined, starts[of], ends[of])
            at[unknown] = self.numbers.n + which
            self.numbers.put(fresh_hashes)
            self.hashes = np.concatenate((self.hashes, fresh_hashes))
            self.pool = np.concatenate((self.pool, new))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            self.seen = np.concatenate((self.seen, np.zeros(len(sizes), np.int64)))
            self.raw = np.concatenate((self.raw, joined[gathered(starts[of], ends[of] - starts[of])]))
            self.raw_ends = np.concatenate((self.raw_ends, self.raw_ends[-1] + np.cumsum(ends[of] - starts[of])))
        same = self.raw_ends[at + 1] - self.raw_ends[at] == ends - starts
        if not same.all() or (self.raw[gathered(self.raw_ends[at], ends - starts)] != joined[gathered(starts, ends - starts)]).any():
            return self.plain(texts)
        np.add.at(self.seen, at, 1)
        lengths = self.ends[at + 1] - self.ends[at]
        out = self.pool[gathered(self.ends[at], lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        sizes = np.diff(total[np.concatenate(([0], np.cumsum(counts)))])
        if self.numbers.n > CACHE:
            self.reset(np.flatnonzero(self.seen > 1)[: CACHE // 2])
        return out, sizes


def encoder(vocabulary: str) -> Encoder:
    """One for each worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def write(docs: DataFrame, path: str, *, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, keep: tuple[str, ...] = ()) -> None:
    """Encodes whole texts and writes them to `path` in the layout above, with the columns `keep` beside the ids.

    Null text is empty: one id, the end id. Documents without id come first; repeated ids stand side by side. An
    empty table writes a table without rows. The range partitioning comes before the encoding: its sampling pass
    then reads texts but encodes nothing.
    """
    bounded_batches(docs.sparkSession)
    t, extra = fresh(docs.columns, "text", "ids")[0], [c for c in keep if c not in ("doc_id", "bucket", "n_tokens", "ids")]
    rows = docs.select("doc_id", *extra, F.col("text").alias(t)).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = docs.select("doc_id", *extra).schema.add("n_tokens", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType(), False))

    def encoded(batches):
        for b, texts in steps(batches, t):
            ids, sizes = encoder(vocabulary)(texts)
            ids = np.insert(ids, np.cumsum(sizes), np.int32(end_id))
            sizes = (sizes + 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *extra)], pa.array(sizes), lists], ["doc_id", *extra, "n_tokens", "ids"])

    out = rows.mapInArrow(encoded, schema).withColumn("bucket", F.spark_partition_id())
    out.write.options(**LAYOUT).parquet(path)


def read(spark, path: str) -> DataFrame:
    """The table as written; select what is needed, filters on doc_id reach the page index."""
    return spark.read.parquet(path)


def starts(spark, path: str) -> DataFrame:
    """doc_id, bucket, n_tokens, start: the ids of all documents before; reads no ids. Repeated doc_ids stand in order of n_tokens."""
    sizes = read(spark, path).select("doc_id", "bucket", "n_tokens")
    return _start(sizes, sizes, ["doc_id", "n_tokens"])


def _start(rows: DataFrame, sizes: DataFrame, order: list[str]) -> DataFrame:
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    totals = sizes.groupBy(F.col("bucket").alias("b")).agg(F.sum("n_tokens").alias("s")).select("b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, F.col("bucket") == F.col("b")).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "b")


def digests(spark, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of the ids as little-endian unsigned 32-bit integers)."""

    def crc(batches):
        for b in batches:
            ids = b.column("ids")
            at = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            out = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("bucket"), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(out, pa.int64())], ["doc_id", "bucket", "n_tokens", "ids_crc32"])

    files = read(spark, path)
    rows = files.select("doc_id", "bucket", "ids").mapInArrow(crc, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, bucket int, n_tokens long, ids_crc32 long")
    return _start(rows, files.select("bucket", "n_tokens"), ["doc_id", "n_tokens", "ids_crc32"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1_tokens(spark, sf_dir):
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
