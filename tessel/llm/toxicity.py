"""Counterfactual-regularised toxicity classifier (operator 9).

A document is the set of its distinct words (A-Z lower-cased, ASCII punctuation and white
space as separators) and of their prefixes, which catch stems with varying endings; its
score is the logistic function of a bias and the sum of its
keys' weights. Weights are fitted in numpy by proximal gradient steps on

    logistic loss on labelled documents
    + ``pair_weight`` * mean squared change of a labelled sentence's logit when an identity
      term in it is swapped for another of its group
    + ``l1`` * sum of absolute weights.

Each identity term of a sentence gives a pair for each other term of its group; up to
``max_pairs`` sentences without one give pairs by standing in two terms of one group, the
groups in turn, for one of their words, so that terms rare or absent in the labels are held
too. Both sorts have half of the weight. The L1 term leaves
weights on the few keys that carry the label, so a long text gathers no noise.

Words are keyed by 64-bit hashes, not buckets: a key outside the training vocabulary has
weight zero whatever the corpus size. Only labelled rows are fitted, at most
``max_per_class`` rows of each class (a documented bound); every document is scored.
Null and empty texts get the bias's score. Without labels of both classes the score is the
constant (n1 + 1) / (n0 + n1 + 2).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .common import labelled_sample, release, tidy

#: Identity terms by group; a parameter of fit().
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("disabled", "blind", "deaf"),
)

#: Prefix lengths in bytes: stems whose endings vary.
PREFIXES = (3, 4, 5, 6, 8)
SLICE = 1 << 18  # bytes of text at a time
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted uint64 hashes of the words with a weight
    weights: np.ndarray
    bias: float


def word_keys(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (hash, row): the words of each row, then their prefixes by length in bytes."""
    low = N.LOWER[data]
    starts, ends, rows = N.word_spans(low, offsets, SEPARATOR)
    up, down = N.powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, N.U64)
    np.cumsum(N.BYTE_CODE[low] * up[: len(low)], out=sums[1:])
    base, turn = sums[starts], down[starts]
    yield N.mix((sums[ends] - base) * turn), rows
    for k in PREFIXES:
        own = np.flatnonzero(ends - starts >= k)
        yield N.mix((sums[starts[own] + k] - base[own]) * turn[own] + N.U64(k)), rows[own]


def distinct_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct words and prefixes of each row."""
    parts, first = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for part in N.slices(pa.record_batch([column], ["text"]), max_bytes=1 << 20):
        hashes, rows = (np.concatenate(x) for x in zip(*word_keys(*N.utf8(part.column(0))), strict=True))
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        parts.append((hashes[keep], rows[keep] + first))
        first += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def swap_pairs(texts: Sequence[str], groups: Sequence[Sequence[str]], max_made: int, seed: int = 7) -> Iterator[tuple[str, str, bool]]:
    """Pairs of sentences that differ in one identity term only, and whether the terms were put in.

    Every term of every sentence is swapped; ``max_made`` bounds the pairs with terms put in.
    """
    rng = np.random.default_rng(seed)
    group_of = {w: g for g in groups for w in g}
    term = re.compile(r"\b(" + "|".join(map(re.escape, sorted(group_of))) + r")\b", re.IGNORECASE)
    made = 0
    for text in texts:
        for sentence in re.split(r"(?<=[.!?\n])\s+", text or ""):
            found = False
            for m in term.finditer(sentence):
                found = True
                for other in group_of[m[1].lower()]:
                    if other != m[1].lower():
                        yield sentence, sentence[: m.start()] + other + sentence[m.end() :], False
            if not found and made < max_made and (words := sentence.split()):
                at = int(rng.integers(len(words)))
                g = groups[made % len(groups)]
                a, b = rng.choice(len(g), 2, replace=False)
                made += 1
                yield *(" ".join([*words[:at], g[k], *words[at + 1 :]]) for k in (a, b)), True


def differences(pairs: Iterator[tuple[str, str, bool]], vocabulary: np.ndarray, block: int = 500) -> tuple[np.ndarray, ...]:
    """(column, row, sign) of the distinct differences of pairs, and the weight of each row.

    Equal differences are one row, so memory doesn't grow with the pairs. Found pairs and
    pairs with terms put in have half of the weight each.
    """
    counts: dict[tuple[int, ...], list[int]] = {}
    while part := list(islice(pairs, block)):
        net = []
        for side, sign in ((0, 1), (1, -1)):
            h, r = distinct_keys(pa.array([x[side] for x in part], pa.string()))
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            ok = vocabulary[at] == h
            net.append((r[ok] * len(vocabulary) + at[ok], sign))
        left, right = net[0][0], net[1][0]
        signed: list[list[int]] = [[] for _ in part]
        for cells, sign in ((np.setdiff1d(left, right), 1), (np.setdiff1d(right, left), -1)):
            for cell in cells.tolist():
                signed[cell // len(vocabulary)].append(sign * (cell % len(vocabulary) + 1))
        for key, (_, _, put_in) in zip(signed, part, strict=True):
            counts.setdefault(tuple(key), [0, 0])[put_in] += 1
    n = np.array(list(counts.values()) or [[0, 0]], float)
    total = n.sum(0)
    weight = (n / np.maximum(total, 1)).sum(1) / max(1, np.count_nonzero(total))
    flat = np.array([x for key in counts for x in key], np.int64)
    row = np.repeat(np.arange(len(counts)), [len(key) for key in counts]).astype(np.int64)
    return np.abs(flat) - 1, row, np.sign(flat).astype(float), weight


def fit(
    texts: Sequence[str | None], labels: Sequence[int], groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
    l1: float = 6e-3, pair_weight: float = 1.0, max_pairs: int = 2000, steps: int = 400, min_rows: int = 3,
) -> Model:
    """Fit on labelled texts; see the module text for the objective."""
    y = np.asarray(labels, float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    hashes, rows = distinct_keys(pa.array(list(texts), pa.string()))
    vocabulary, count = np.unique(hashes, return_counts=True)
    terms = np.unique(next(word_keys(*N.utf8(pa.array([w for g in groups for w in g], pa.string()))))[0])
    # a key whose share hardly differs between the classes stays at zero under the L1 term
    share1 = np.bincount(np.searchsorted(vocabulary, hashes), y[rows], len(vocabulary)) / n1
    share0 = (count - share1 * n1) / n0
    lively = (count >= min_rows) & (np.abs(share1 - share0) >= l1)
    vocabulary = np.union1d(vocabulary[lively], terms)

    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    ok = vocabulary[at] == hashes
    col, row = at[ok], rows[ok]
    pcol, prow, psign, share = differences(swap_pairs([t or "" for t in texts], groups, max_pairs), vocabulary)
    size, n_pairs = len(vocabulary), len(share)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    # accelerated proximal gradient with a diagonal step from each word's share of rows
    width = weight * (np.bincount(row, minlength=len(y)) + 1) / 4
    curve = np.bincount(col, width[row], size) + 1e-6
    curve += pair_weight * 2 * np.bincount(pcol, (share * np.bincount(prow, minlength=n_pairs))[prow], size)
    w = v = np.zeros(size)
    b = vb = 0.0
    t = 1.0
    for _ in range(steps):
        z = np.bincount(row, v[col], len(y)) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(col, g[row], size)
        change = np.bincount(prow, v[pcol] * psign, n_pairs)
        grad += pair_weight * 2 * np.bincount(pcol, (share * change)[prow] * psign, size)
        new = v - grad / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        nb = vb - g.sum() / width.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_next * (new - w), nb + (t - 1) / t_next * (nb - b)
        w, b, t = new, nb, t_next
    # Lasso shrinks the kept weights; refit them and the bias without it, with a mild ridge
    kept = np.abs(w) > 1e-3
    place = np.cumsum(kept) - 1
    ok, pok = kept[col], kept[pcol]
    col, row, pcol, prow, psign = place[col[ok]], row[ok], place[pcol[pok]], prow[pok], psign[pok]
    w, size = w[kept], int(kept.sum())
    x = np.zeros((len(y), size + 1))
    x[row, col] = 1
    x[:, size] = 1  # the bias
    d = np.zeros((n_pairs, size + 1))
    np.add.at(d, (prow, pcol), psign)
    ridge = np.full(size + 1, 3e-5)
    ridge[size] = 1e-6
    curve = 2 * pair_weight * d.T @ (d * share[:, None]) + np.diag(ridge)
    w = np.append(w, b)
    for _ in range(25):  # Newton steps on the few keys kept
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + curve @ w
        w = w - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + curve, grad)
    w, b = w[:size], w[size]
    return Model(vocabulary[kept], w, float(b))


def _scores(batch: pa.RecordBatch, model: Model, sieve: np.ndarray) -> np.ndarray:
    n = batch.num_rows
    z = np.full(n, model.bias)
    if len(model.words):
        data, offsets = N.utf8(batch.column("text"))
        hits = []
        for hashes, rows in word_keys(data, offsets):
            likely = np.flatnonzero(sieve[(hashes >> N.U64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(model.words, hashes[likely]), len(model.words) - 1)
            hit = model.words[at] == hashes[likely]
            hits.append(rows[likely[hit]] * len(model.words) + at[hit])
        once = np.unique(np.concatenate(hits))
        z += np.bincount(once // len(model.words), model.weights[once % len(model.words)], n)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sieve(model: Model) -> np.ndarray:
    sieve = np.zeros(1 << 16, bool)
    sieve[(model.words >> N.U64(48)).astype(np.int64)] = True
    return sieve


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row, from its whole text."""
    sieve = _sieve(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in N.slices(big, max_bytes=SLICE):
                score = _scores(batch, model, sieve)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay."""
    sieve = _sieve(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in N.slices(big, max_bytes=SLICE):
                yield batch.filter(pa.array(_scores(batch, model, sieve) < limit))

    return docs.mapInArrow(run, docs.schema)


def train(documents: DataFrame, labels: DataFrame, admit: Column, max_per_class: int = 2000, **options) -> Model:
    """Fit on at most ``max_per_class`` labelled rows per class admitted by ``admit``."""
    rows = labelled_sample(documents, labels, "toxic", admit, max_per_class).orderBy("doc_id", "text").collect()
    model = fit([r.text for r in rows], [r.label for r in rows], **options)
    del rows
    release()
    return model
