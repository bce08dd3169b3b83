"""SimHash and token files against plain Python."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import components, simhash, tokens

DOCS = "doc_id long, text string, fp string, n_tokens string, key int"


def plain_fp(text, k=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=3):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    v = np.array([fps[i] for i in ids], np.uint64)
    for i, x in enumerate(v):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ x) <= radius):
            a, b = sorted((find(ids[i]), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_table(spark, sf):
    want = {r.doc_id: plain_fp(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    comp = plain_components(want)
    got = simhash.op3_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{want[i]:016x}", comp[i]) for i in want}


def test_links_in_dense_groups(spark):
    """A ball of fingerprints, cut into many blocks, and random ones."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    ball = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))} | {base ^ (0xFF << 20)}
    fps = sorted(ball | {int(x) for x in rng.integers(0, 2**63, 300)} | {0, 1, 3, 7, 15, 31})
    want = plain_components({f: f for f in fps})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), block=64)
    got = {r.node % 2**64: r.root % 2**64 for r in components.components(links).collect()}
    groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in {m[x] for x in m})
    assert groups({f: got.get(f, f) for f in fps}) == groups(want)


def test_simhash_edges(spark):
    rows = [(1, None, "a", "b", 1), (2, "", "a", "b", 1), (3, "one", "a", "b", 1), (4, "One", "a", "b", 1), (None, "one two", "a", "b", 1), (5, "w " * 50_000, "a", "b", 1), (5, "w " * 50_000, "a", "b", 1)]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1, "0" * 16] == got[2, "0" * 16] == 1
    assert got[3, f"{plain_fp('one'):016x}"] == got[4, f"{plain_fp('one'):016x}"] == 3
    assert got[None, f"{plain_fp('one two'):016x}"] is None
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 6])
def test_byte_groups_meet_every_pair(radius):
    from itertools import combinations

    groups = [set(g) for g in simhash.byte_groups(radius)]
    assert all(any(g <= set(same) for g in groups) for same in combinations(range(8), 8 - radius))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(got, docs):
    start = 0
    for r, (i, ids) in zip(sorted(got, key=lambda r: r.doc_id), docs):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = tokens.op1_tokens(spark, sf).collect()
    assert len(got) == len(docs)
    check(got, list(zip([i for i, _ in docs], plain_tokens([t for _, t in docs]))))


def test_token_edges_and_layout(spark, tmp_path):
    texts = ["<|endoftext|>", "<|endoftext|>a", "a<|endoftext|>b c", "x  <|endoftext|>  y", None, "", " ", "  a   b \n c\n\n d  ", "it's 's  've <|endoftext|> x", "é ü ​\x1c z", "word " * 30_000, "a\tb\r\n c", "x" * 10_000]
    rows = [(i, t, "f", "n", 3) for i, t in enumerate(texts)]
    tokens.write(spark.createDataFrame(rows, DOCS), str(tmp_path / "t"), keep=("key", "n_tokens"))
    check(tokens.digests(spark, str(tmp_path / "t")).collect(), list(enumerate(plain_tokens(texts))))
    assert [r.start for r in tokens.starts(spark, str(tmp_path / "t")).orderBy("doc_id").collect()][:2] == [0, 2]
    file = next(f for f in (tmp_path / "t").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    chunks = {pq.ParquetFile(file).metadata.row_group(0).column(i).path_in_schema: pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(5)}
    assert "DELTA_BINARY_PACKED" in chunks["doc_id"].encodings and chunks["doc_id"].has_offset_index and chunks["doc_id"].has_column_index
    tokens.write(spark.createDataFrame([], DOCS), str(tmp_path / "e"))
    assert tokens.digests(spark, str(tmp_path / "e")).count() == 0
    again = spark.createDataFrame([(1, "a b", "", "", 0)] * 3 + [(None, "c", "", "", 0)], DOCS)
    tokens.write(again, str(tmp_path / "r"))
    assert [r.start for r in tokens.digests(spark, str(tmp_path / "r")).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()] == [0, 2, 5, 8]


def test_encoder_on_random_texts(monkeypatch):
    """Any mix of spaces of all kinds, marks, digits and letters; with a table that is full all the time too."""
    import random

    monkeypatch.setattr(tokens, "CACHE", 40)
    rng, e = random.Random(5), tokens.Encoder("byte_bpe_50k.json")
    alphabet = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x00", "\x1c", " ", " ", "　", "\u0085", "a", "b", "The", "é", "ß", "’", "'s", "'", ".", ",", "!", "1", "²", "中", "😀", "word", "<|endoftext|>", "́"]
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        ids, sizes = e([t.encode() for t in texts])
        want = [x[:-1] for x in plain_tokens(texts)]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_encoder_on_short_texts():
    """10**5 short texts with NUL, words that one table entry must not serve, and special tokens; one encoder for all."""
    import random

    rng, e = random.Random(6), tokens.Encoder("byte_bpe_50k.json")
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    alphabet = ["cat\0", "dat", "a\0", "b", "\0", "\t", "\n", " ", " ", "<|endoftext|>", "é", "1", "."]
    texts = [["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(5000)] for _ in range(20)]
    for part in [*texts, ["cat\0", "dat", "x cat\0", "x dat", thue, thue.translate({97: "b", 98: "a"})]]:
        ids, sizes = e([t.encode() for t in part])
        want = [x[:-1] for x in plain_tokens(part)]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_new_words_go_through_the_library_together(monkeypatch):
    """Words apart are few: those at a text's edges, and those that the library's ids do not cover byte for byte."""
    import random

    monkeypatch.setattr(tokens, "PIECE", 500)
    rng, e, alone = random.Random(7), tokens.Encoder("byte_bpe_50k.json"), []
    one = e.ids_of
    monkeypatch.setattr(e, "ids_of", lambda word: alone.append(word) or one(word))
    texts = [" ".join("".join(rng.choice("abcdeé中19.,'") for _ in range(rng.randint(1, 12))) for _ in range(300)) for _ in range(10)]
    texts.append("begins <|endoftext|> within<|endoftext|>words  two spaces ")
    ids, sizes = e([t.encode() for t in texts])
    want = [x[:-1] for x in plain_tokens(texts)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(alone) < 60  # one call a word before
    broken = [b"fresh word\xff and others", b"more unseen words"]
    got = e(broken)
    assert [x.tolist() for x in got] == [x.tolist() for x in e.plain(broken)]


def test_equal_hashes_change_no_ids(monkeypatch):
    """Were all words of one hash, the ids would still be the library's."""
    monkeypatch.setattr(tokens, "hashed_spans", lambda joined, starts, ends: np.full(len(starts), 5, np.uint64))
    texts = ["some words", "and other words", ""]
    ids, sizes = tokens.Encoder("byte_bpe_50k.json")([t.encode() for t in texts])
    assert ids.tolist() == [i for x in plain_tokens(texts) for i in x[:-1]] and len(sizes) == 3


def test_hashes():
    from siltstone.llm import arrowops

    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 99, n, np.uint8)) + b"\0" * int(z) for n, z in zip(rng.integers(1, 90, 4000), rng.integers(0, 2, 4000))]
    h, sizes = arrowops.hashed_words([b" ".join(words[:1000]), b"", b" ".join(words[1000:])])
    assert sizes.tolist() == [1000, 0, 3000]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(words, h.tolist())))
    for w in (1, 2, 5, 35):
        got = arrowops.hashed_windows(h % np.uint64(3), w).tolist()
        runs = [tuple(x) for x in np.lib.stride_tricks.sliding_window_view(h % np.uint64(3), w).tolist()]
        assert len(set(got)) == len(set(runs)) == len(set(zip(runs, got)))
    assert len(arrowops.hashed_windows(h[:3], 5)) == 0
