"""Arrow and NumPy helpers of the operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows a step works on at once; keeps its arrays to some MB whatever the size of Spark's batches.
STEP_BYTES = 1_000_000


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about STEP_BYTES of text each, or one longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
            part = b.slice(at, stop - at)
            yield part, text_bytes(part.column(text))
            at = stop
        pa.default_memory_pool().release_unused()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: the batches hold rows sorted by `keys`, and no group is cut. Small groups come many to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = {k: b.column(k)[b.num_rows - 1] for k in keys}
        same = np.ones(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            same &= c.to_numpy(zero_copy_only=False) == last[k].as_py()
        first = int(np.argmax(same))  # where the last group of this batch begins
        if first == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1] == last[k] for k in keys):
            held.append(b)
            continue
        if held or first:
            done = [*held, b.slice(0, first)]
            yield pa.Table.from_batches([x for x in done if x.num_rows] or [b.slice(0, 0)])
        held = [b.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each window of w neighbours, by doubling: len(a) - w + 1 values."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = bounds(keys)[:-1]
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64); one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a followed by b; one to one in each while the other stands."""
    return mixed(mixed(a + np.uint64(0x9E3779B97F4A7C15)) + b)


#: Longer spans are hashed one by one.
LONG = 64


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: the length, then eight bytes a round, all mixed. Spans of one length up to 8 bytes have one hash only if equal."""
    size = ends - starts
    h = mixed(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live = np.flatnonzero(size <= LONG)
    for done in range(0, LONG, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        x = eight[starts[live] + done]
        over = np.maximum(8 - (size[live] - done), 0).astype(np.uint64) * np.uint64(8)
        h[live] = after(h[live], (x << over) >> over)
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]], 7)
    return h


def hashed_windows(values: np.ndarray, w: int) -> np.ndarray:
    """Hashes of all runs of w neighbours (len - w + 1 of them): a tree of ordered, mixed pairs over runs of 1, 2, 4 ..."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, at, size = None, 0, 1
    while w:
        if w & 1:
            part = values[at : at + n]
            out = part if out is None else after(out, part)
            at += size
        w >>= 1
        if w:
            values = after(values[:-size], values[size:])
            size *= 2
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def placed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, where their words begin and end in it, and how many words each text has."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = np.concatenate(([False], ~_SPACE[joined], [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    cuts = np.cumsum([len(t) + 1 for t in texts])
    return joined, starts, ends, np.diff(np.searchsorted(starts, cuts), prepend=0)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and how many words each text has."""
    joined, starts, ends, sizes = placed_words(texts)
    return hashed_spans(joined, starts, ends), sizes
