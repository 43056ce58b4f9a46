"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 8).

Texts and benchmark items are taken as their words joined by one blank (A-Z lower-cased,
split at white space), read as code points. The symbol at a position is its gram of GRAM
characters. At every position starts a CGK random walk: at step j it emits the symbol it
stands on and moves on by one random bit that depends on j and the symbol. Two windows at
small edit distance fall back into step, so edit distance becomes Hamming distance, and the
symbols emitted before the first and after the last of STEPS steps are the walk's key. Each table has its own walk.

Every position of an item is one draw, entered under its key. A text position with an
item's key votes for the window that it and the item's position line up; votes are counted
by row, item and band of line-ups. How many votes an item's window must have is set by
``calibrate``: copies of the item with ``max_share`` of its characters edited, at random
places, at even distances and by replacement at even distances, go through the same search, and the bar is BAR of the least
vote among them. An item enters as many tables, up to ``tables``, as lift its bar to
LEAST_VOTES. The aim is a recall of 0.9 at every edit rate up to ``max_share``; the tests
measure it against brute force.

Items that do not get there, short ones above all, are searched exactly: k edits leave one
of k + 1 disjoint pieces whole, so every text position that holds a piece is a vote and one
vote is enough.

Voted windows are verified exactly: the least edit distance, in characters, between the item
and any part of the window with its slack, by the bit-parallel method. Up to ``max_share`` of
the item's characters may differ. Null or empty items match nothing; null and empty texts
hold nothing. Items are taken in blocks of ``block_items``, each sent to the tasks as a table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .common import tidy

GRAM = 4
STEPS = 8  # a power of two, at most 8
LEAST_VOTES = 3
BAR = 0.8
TRIALS = 12  # copies of an item to calibrate by, by thirds: edits at random places, at even distances, the same by replacement only
LONGEST_PIECE = 12
BANDS = 5  # a band of line-ups is this part of the edits an item may have
LEMMA = 5
SLICE = 1 << 18  # bytes of text at a time: a slice's arrays stay in the processor's cache
SIEVE = 20
U64 = np.uint64
#: A multiplier for each table; a walk's bits are the leading ones of the product.
ODD = tuple(U64((0xD6E8FEB86659FD93 * (2 * t + 1)) % (1 << 64)) for t in range(16))


def plain(raw: bytes) -> str:
    """The words of a text joined by blanks, A-Z lower-cased."""
    return b" ".join(raw.lower().split()).decode("utf-8", "replace")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` code points from every position; zeros follow the last."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(size, np.uint32)]).astype(U64)
    out = np.full(n, U64(size), U64)
    for k in range(size):
        out += padded[k : k + n] + U64(1)
        out *= U64(0x9FB21C651E98DF25)
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def moved(first: np.ndarray, then: np.ndarray, most: int) -> np.ndarray:
    """Moves of two runs of steps in a row, from every position; ``first`` moves up to ``most``."""
    out = first.copy()
    for k in range(most + 1):
        later = np.concatenate([then[k:], np.zeros(k, np.uint8)])
        later *= first == k
        out += later
    return out


def walk_keys(symbols: np.ndarray, table: int) -> np.ndarray:
    """Keys of the walks of STEPS steps from every position, of the first and the last symbol."""
    bits = ((symbols * ODD[table]) >> U64(64 - STEPS)).astype(np.uint8)
    runs, most = [(bits >> j) & 1 for j in range(STEPS)], 1
    while len(runs) > 1:
        runs, most = [moved(a, b, most) for a, b in zip(runs[::2], runs[1::2], strict=True)], 2 * most
    end = np.arange(len(symbols), dtype=np.int32)
    end += runs[0]
    key = symbols ^ U64(table + 1)
    key *= U64(0x9FB21C651E98DF25)
    key += symbols.take(end, mode="clip")  # symbols are hashes; a walk may end past the last one
    return key


def lemma_codes(codes: np.ndarray) -> np.ndarray:
    """16-bit hashes of the LEMMA characters from every position."""
    parts = [gram_hashes(codes[k : k + SLICE + LEMMA], LEMMA)[:SLICE] >> U64(48) for k in range(0, len(codes), SLICE)]
    return np.concatenate([p.astype(np.uint16) for p in parts] or [np.zeros(0, np.uint16)])


def infix_distance(pattern: str, text: str, limit: int) -> int | None:
    """Least edit distance of ``pattern`` to any substring of ``text``, None above ``limit``."""
    if pattern in text:
        return 0
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        peq[ch] |= 1 << i
    pv, mv, score, best = full, 0, m, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best if best <= limit else None


def edited(codes: np.ndarray, edits: int, rng: np.random.Generator, even: bool, replace: bool = False) -> np.ndarray:
    """A copy with ``edits`` characters replaced, added or left out, or all of them replaced."""
    n = len(codes)
    at = ((np.arange(edits) + rng.random()) * n / edits).astype(int) if even else np.sort(rng.choice(n, edits, replace=False))
    kind, other = rng.integers(0, 1 if replace else 3, edits), codes[rng.integers(0, n, edits)]
    other = np.where(other == codes[at], codes.max() + 1, other)
    out = np.insert(codes, at[kind == 1] + 1, other[kind == 1])
    place = at + np.cumsum(kind == 1) - (kind == 1)
    out[place[kind == 0]] = other[kind == 0]
    return np.delete(out, place[kind == 2])


class Index:
    """Items, their keys by table, and the search of a batch of texts.

    ``plan`` has (tables, votes needed) of each item; no tables means the exact search.
    """

    def __init__(self, items: Sequence[tuple[object, str | None]], max_share: float, plan: Sequence[tuple[int, int]]):
        self.ids = [i for i, _ in items]
        self.texts = [plain((t or "").encode("utf-8", "replace")) for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.limits = np.array([int(max_share * n) for n in self.sizes], np.int64)
        self.need = np.array([votes for _, votes in plan], np.int64)
        self.grams = [lemma_codes(code_points(t))[: max(0, len(t) - LEMMA + 1)] for t in self.texts]
        self.whole = np.array([len(g) for g in self.grams], np.int64) - LEMMA * self.limits
        self.distinct = np.array([len(np.unique(g)) for g in self.grams], np.int64)
        self.width = self.limits // BANDS + 1
        found: dict[tuple[str, int], list] = defaultdict(list)
        for i, (text, (tables, _)) in enumerate(zip(self.texts, plan, strict=True)):
            if not text:
                continue
            codes = code_points(text)
            if tables:
                symbols = gram_hashes(codes, GRAM)
                for t in range(tables):
                    found["walk", t].append((walk_keys(symbols, t), i, np.arange(len(codes))))
            else:
                step = max(1, len(codes) // (int(self.limits[i]) + 1))
                size = min(step, LONGEST_PIECE)
                place = np.arange(min(int(self.limits[i]) + 1, len(codes))) * step
                found["piece", size].append((gram_hashes(codes, size)[place], i, place))
        self.keys, self.sieve = {}, {}
        for kind, parts in found.items():
            key = np.concatenate([k for k, _, _ in parts])
            item = np.repeat(np.array([i for _, i, _ in parts], np.int32), [len(k) for k, _, _ in parts])
            place = np.concatenate([p for _, _, p in parts]).astype(np.int32)
            order = np.lexsort((place, item, key))
            key, run, count = np.unique(key[order], return_index=True, return_counts=True)
            self.keys[kind] = key, run, count, item[order], place[order]
            # a bit table of the keys' leading bits keeps most positions from the exact lookup
            bit = np.zeros(1 << SIEVE, bool)
            bit[(key >> U64(64 - SIEVE)).astype(np.int64)] = True
            self.sieve[kind] = bit

    def votes(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, band and start of every vote, sorted, for the rows that begin at ``first``."""
        at, item, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(0, len(codes), SLICE):  # one text may be far longer than a slice
            part = codes[begin : begin + SLICE + 64]
            symbols = gram_hashes(part, GRAM) if any(k == "walk" for k, _ in self.keys) else None
            for (kind, n), (key, run, runs, items, places) in self.keys.items():
                own = walk_keys(symbols, n) if kind == "walk" else gram_hashes(part, n)
                own = own[:SLICE]
                likely = np.flatnonzero(self.sieve[kind, n].take((own >> U64(64 - SIEVE)).astype(np.int64)))
                own = own[likely]
                lo = np.searchsorted(key, own)
                met = np.flatnonzero(key.take(lo, mode="clip") == own)
                count, lo = runs[lo[met]], run[lo[met]]
                entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                q = np.repeat(likely[met], count) + begin
                at.append(q)
                item.append(items[entry].astype(np.int64))
                start.append(q - places[entry])
        at, item, start = (np.concatenate(x) for x in (at, item, start))
        row = np.searchsorted(first, at, "right") - 1
        # a line-up may begin before its row: whole items fit before the first position
        band = (start + int(self.sizes.max(initial=0)) + 1) // self.width[item]
        order = np.argsort(((row * len(self.ids) + item) << 32) + band)
        return row[order], item[order], band[order], start[order]

    def tallies(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, band, votes of the band and the next one, and where the band's votes begin and the next one's end."""
        row, item, band, start = self.votes(codes, first)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        lead = np.flatnonzero(new)
        end = np.append(lead[1:], len(row))
        row, item, band = row[lead], item[lead], band[lead]
        both = np.zeros(len(lead), bool)
        both[:-1] = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1)
        stop = np.where(both, np.append(end[1:], 0), end)
        return row, item, band, stop - lead, lead, stop, start

    def alike(self, grams: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the windows [a, b) that have as many of their item's grams as edits must leave.

        All windows of an item at once; a gram that comes again in a window counts again.
        """
        order, mine, keep = np.argsort(item, kind="stable"), np.zeros(1 << 16, bool), []
        bounds = np.append(np.flatnonzero(np.diff(item[order], prepend=-1)), len(order))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = order[lo:hi]
            i = int(item[own[0]])
            size = b[own] - a[own]
            end = np.cumsum(size)
            place = np.repeat(a[own] - (end - size), size) + np.arange(end[-1])
            mine[self.grams[i]] = True
            met = np.concatenate([[0], np.cumsum(mine[grams[np.minimum(place, len(grams) - 1)]])])
            mine[self.grams[i]] = False
            keep.append(own[met[end] - met[end - size] >= self.distinct[i] - LEMMA * self.limits[i]])
        return np.sort(np.concatenate(keep)) if keep else order

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, edit distance, first word) of every row's best match of each item."""
        data, offsets = N.utf8(column)
        raw = data.tobytes()
        texts = [plain(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        if not self.keys or not any(texts):
            return []
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        codes = code_points(" ".join(texts))
        row, item, band, count, lead, stop, start = self.tallies(codes, first[:-1])
        good = np.flatnonzero(count >= self.need[item])
        row, item, band, lead, stop = (x[good] for x in (row, item, band, lead, stop))
        new = np.ones(len(good), bool)  # bands nearer than the slack share a window
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | ((band[1:] - band[:-1]) * self.width[item[1:]] > 2 * self.limits[item[1:]] + 2)
        new = np.flatnonzero(new)
        last = np.append(new[1:], len(good))[: len(new)] - 1
        row, item = row[new], item[new]
        width, slack = self.width[item], self.limits[item] + 1
        shift = int(self.sizes.max(initial=0)) + 1
        a = np.maximum(band[new] * width - shift - slack, first[row])
        b = np.minimum((band[last] + 2) * width - shift + self.sizes[item] + slack, first[row + 1] - 1)
        grams, there, whole = lemma_codes(codes), np.zeros(1 << 16, bool), self.whole.tolist()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        near_enough = self.alike(grams, item, a, b)
        for g, r, i, a, b in zip(near_enough.tolist(), row[near_enough].tolist(), item[near_enough].tolist(), a[near_enough].tolist(), b[near_enough].tolist(), strict=True):
            # an edit touches at most LEMMA of the item's grams, so ``whole`` of them at least are left
            near = grams[a:b]
            there[near] = True
            left = np.count_nonzero(there[self.grams[i]])
            there[near] = False
            if left < whole[i]:
                continue
            begin = int(first[r])
            d = infix_distance(self.texts[i], texts[r][a - begin : b - begin], int(self.limits[i]))
            if d is not None and ((r, i) not in best or d < best[r, i][0]):
                at = max(0, int(np.median(start[lead[new[g]] : stop[last[g]]])) - begin)
                best[r, i] = d, texts[r].count(" ", 0, at)
        return [(r, i, d, s) for (r, i), (d, s) in sorted(best.items())]


def calibrate(items: Sequence[tuple[object, str | None]], max_share: float, tables: int) -> list[tuple[int, int]]:
    """(tables, votes needed) of each item; (0, 1) asks for the exact search."""
    plan = [(0, 1)] * len(items)
    texts = [code_points(plain((t or "").encode("utf-8", "replace"))) for _, t in items]
    rng = np.random.default_rng(11)
    left = [i for i, c in enumerate(texts) if int(max_share * len(c)) and len(c) >= 4 * GRAM]
    for t in range(1, min(tables, len(ODD)) + 1):
        below = []
        for s in range(0, len(left), 256):
            part = left[s : s + 256]
            index = Index([items[i] for i in part], max_share, [(t, 1)] * len(part))
            copies = [edited(texts[i], int(max_share * len(texts[i])), rng, k % 3 != 0, k % 3 == 1) for i in part for k in range(TRIALS)]
            first = np.cumsum([0] + [len(c) + 1 for c in copies])
            joined = np.concatenate([x for c in copies for x in (c, np.array([32], np.uint32))])
            row, item, _, count, *_ = index.tallies(joined, first[:-1])
            own = row // TRIALS == item
            most = np.zeros(len(copies), np.int64)
            np.maximum.at(most, row[own], count[own])
            bar = (BAR * most.reshape(len(part), TRIALS).min(1)).astype(int)
            for i, votes in zip(part, bar.tolist(), strict=True):
                if votes >= LEAST_VOTES:
                    plan[i] = (t, votes)
                else:
                    below.append(i)
        left = below
    return plan


def item_blocks(items: DataFrame, block_items: int) -> Iterator[list[tuple[object, str | None]]]:
    blocks = max(1, -(-items.count() // block_items))
    for b in range(blocks):
        part = items.select("item_id", "text").where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, max_share: float = 0.15, tables: int = 6, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, distance, at_word), one row for each item found in each text."""
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, at_word long"
    out = None
    for block in item_blocks(items, block_items):
        found = _map(docs.select("doc_id", "text"), block, schema, max_share, tables)
        out = found if out is None else out.unionByName(found)
    return out


def _map(docs: DataFrame, block: list, schema: str, max_share: float, tables: int) -> DataFrame:
    plan = calibrate(block, max_share, tables)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block, max_share, plan)
        for big in batches:
            for batch in N.slices(big, max_bytes=SLICE):
                hits = index.search(batch.column("text"))
                doc = batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                item = pa.array([index.ids[h[1]] for h in hits], kind)
                yield pa.RecordBatch.from_arrays(
                    [doc, item, pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int64())],
                    ["doc_id", "item_id", "distance", "at_word"],
                )

    kind = pa.int64() if not block or isinstance(block[0][0], int) else None
    return docs.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, items: DataFrame, max_share: float = 0.15, tables: int = 6, block_items: int = 20_000) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay."""
    for block in item_blocks(items, block_items):
        plan = calibrate(block, max_share, tables)

        @tidy
        def run(batches: Iterator[pa.RecordBatch], block=block, plan=plan) -> Iterator[pa.RecordBatch]:
            index = Index(block, max_share, plan)
            for big in batches:
                for batch in N.slices(big, max_bytes=SLICE):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[h[0] for h in index.search(batch.column("text"))]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
