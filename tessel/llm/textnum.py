"""Numpy views of Arrow text columns: words, shingles and their 64-bit hashes.

Everything works on whole batches of UTF-8 bytes. A word's hash is a polynomial in an odd
base modulo 2**64, taken from one running sum, then finalised; it depends on the word's
bytes alone, so all tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, U64), np.ones(1, U64)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODE = (np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) ^ U64(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (uint64 in, uint64 out)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, 1 << 16), U64(base), U64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def forget_powers() -> None:
    """Drop the powers; the next call of ``powers`` makes what it needs."""
    _POWERS[:] = [np.ones(1, U64), np.ones(1, U64)]


def slices(batch: pa.RecordBatch, text: str = "text", max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``max_bytes`` of text, so that temporaries stay small.

    A longer text comes alone. Rows are never dropped or cut.
    """
    if not batch.num_rows:
        return
    col = batch.column(text)
    lengths = np.nan_to_num(np.asarray(pc.binary_length(col).cast(pa.float64()).to_numpy(zero_copy_only=False)))
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of all rows (bytes not in ``space``)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    blank = space.take(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first[1:].copy()  # the byte ends a word if the next is blank or another row's
    edge[:-1] |= blank[1:]
    edge &= ~blank
    ends = np.flatnonzero(edge) + 1
    edge = first[:-1]
    edge[1:] |= blank[:-1]
    edge &= ~blank
    starts = np.flatnonzero(edge)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all n-word shingles; a row of 1 to n-1 words gives its whole sequence."""
    counts = np.bincount(rows, minlength=n_rows)
    total = len(hashes)
    acc = hashes.copy()
    short_hash: list[np.ndarray] = []
    short_row: list[np.ndarray] = []
    first = np.cumsum(counts) - counts
    for k in range(1, n):
        # rows of exactly k words: acc now holds the hash of k words from each position
        own = np.flatnonzero(counts == k)
        short_hash.append(mix(acc[first[own]] + U64(k)))
        short_row.append(own)
        nxt = np.zeros(total, U64)
        nxt[: max(total - k, 0)] = hashes[k:]
        acc = mix(acc * U64(0x9FB21C651E98DF25) + nxt)
    keep = np.zeros(total, bool)
    if total >= n:
        keep[: total - n + 1] = rows[: total - n + 1] == rows[n - 1 :]
    return np.concatenate([acc[keep], *short_hash]), np.concatenate([rows[keep], *short_row])


def row_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row, as values and row offsets.

    Words are the maximal runs without white space, A-Z lower-cased.
    """
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    values, owner = shingles(span_hashes(low, starts, ends), rows, len(offsets) - 1, n)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(offsets)))
