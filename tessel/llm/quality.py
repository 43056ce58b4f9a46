"""Quality classifier by supervised subword embeddings (operator 5).

A text's features are its words and its character n-grams (3 to 5 code points, on the text
and on its shape, where letters and digits stand for their kind), and
whether a word is its neighbour or the next but one again, all hashed into buckets. Each
bucket has a learned vector; a document is the mean of its features' vectors; a softmax
over the two classes gives its score. Vectors and output weights are learned together in
numpy by stochastic gradient descent over shuffled documents.

Only labelled rows are fitted, at most ``max_per_class`` of each class (a documented
bound); every document is scored, over its whole text. As the output is linear in the mean,
scoring needs one number a bucket: its vector's product with the difference of the output
rows. Null and empty texts get the bias's score. Without labels of both classes the score
is the constant (n1 + 1) / (n0 + n1 + 2).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import textnum as N
from .common import labelled_sample, release

GRAMS = (3, 4, 5)
SHAPE_GRAMS = (3, 4)


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray  # by bucket: vector times output difference
    bias: float


def _shape_table() -> np.ndarray:
    out = np.arange(128, dtype=np.uint32)
    for c in range(128):
        ch = chr(c)
        out[c] = ord("a") if ch.islower() else ord("A") if ch.isupper() else ord("0") if ch.isdigit() else c
    return out


SHAPE = _shape_table()
_SPACE128 = np.array([chr(c) in " \t\n\r\x0b\x0c" for c in range(128)])


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t or "" for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=offsets[1:])
    return np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def shape_of(points: np.ndarray) -> np.ndarray:
    """Lower-case, upper-case letters and digits as a, A, 0; letters beyond ASCII as a."""
    low = np.minimum(points, 127)
    return np.where(points < 128, SHAPE[low], np.where(points < 0x2000, np.uint32(97), points))


def features(texts: Sequence[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (bucket, row) pairs: every occurrence of every feature."""
    points, offsets = code_points(texts)
    n = len(points)
    if not n:
        return
    up, down = N.powers(n + 1)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    shift = N.U64(64 - bits)

    def sums(p: np.ndarray) -> np.ndarray:
        c = np.zeros(n + 1, N.U64)
        np.cumsum((p.astype(N.U64) + N.U64(1)) * N.U64(0xD1342543DE82EF95) * up[:n], out=c[1:])
        return c

    def buckets(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ (h >> N.U64(29))) * N.U64(0xBF58476D1CE4E5B9 + 2 * salt)
        h ^= h >> N.U64(32)
        return ((h * N.U64(0x94D049BB133111EB)) >> shift).astype(np.int32)

    own = sums(points)
    for family, c, grams in ((0, own, GRAMS), (1, sums(shape_of(points)), SHAPE_GRAMS)):
        for g in grams:
            if n >= g:
                h = (c[g:] - c[:-g]) * down[: n - g + 1]
                ok = row[: n - g + 1] == row[g - 1 :]
                yield buckets(h[ok], 16 * family + g), row[: n - g + 1][ok]
    space = (points < 128) & _SPACE128[np.minimum(points, 127)]
    inside = ~space
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.r_[True, space[:-1]] | edge[:n]))
    ends = np.flatnonzero(inside & (np.r_[space[1:], True] | edge[1:])) + 1
    words, owner = (own[ends] - own[starts]) * down[starts], row[starts]
    yield buckets(words, 64), owner
    for lag in (1, 2):  # the shape of word pairs: does a word come again
        same = (words[lag:] == words[:-lag]).astype(N.U64)
        ok = owner[lag:] == owner[:-lag]
        yield buckets(same[ok] + N.U64(1), 80 + lag), owner[lag:][ok]


def fit(texts: Sequence[str | None], labels: Sequence[int], bits: int = 17, dim: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 3) -> Model:
    """Learn the vectors and the output by SGD, one document a step."""
    y = np.asarray(labels, int)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        p = (n1 + 1) / (n0 + n1 + 2)
        return Model(bits, np.zeros(1 << bits, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        found = [b for b, _ in features([text], bits)]
        ids, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
        docs.append((ids, (count / max(1, count.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    total, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            lr = rate * (1 - step / total)
            step += 1
            hidden = share @ vectors[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[i]
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            # the mean has as many terms as the text has features; scale the step to match
            vectors[ids] -= (lr * np.sqrt(share)[:, None] * 0.5) * back
    return Model(bits, (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def score_texts(texts: Sequence[str | None], model: Model) -> np.ndarray:
    n = len(texts)
    total, count = np.zeros(n), np.zeros(n)
    for bucket, row in features(texts, model.bits):
        total += np.bincount(row, model.weights[bucket], n)
        count += np.bincount(row, minlength=n)
    z = total / np.maximum(count, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in N.slices(big, max_bytes=1 << 20):
                score = score_texts(batch.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def train(documents: DataFrame, labels: DataFrame, admit: Column, max_per_class: int = 1500, **options) -> Model:
    """Fit on at most ``max_per_class`` labelled rows per class admitted by ``admit``."""
    rows = labelled_sample(documents, labels, "quality", admit, max_per_class).orderBy("doc_id", "text").collect()
    model = fit([r.text for r in rows], [r.label for r in rows], **options)
    del rows
    release()
    return model
