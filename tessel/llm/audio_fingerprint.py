"""Chroma audio fingerprints of media columns (operator 10).

A recording (16-bit mono samples as bytes) becomes pitch-class frames: windowed spectra whose
energy is summed into twelve pitch classes and scaled to length one. An integral image over
frames and classes gives every rectangle's sum at once; FILTERS compare rectangles at each
frame, each comparison is quantised to two Gray-coded bits, and sixteen of them pack into one
32-bit integer a frame.

Recordings with equal fingerprints are one class, named by its least id. Queries are aligned
against all classes: equal integers vote for an offset, the offset with the most votes (the
least on ties) is verified by the share of differing bits over the whole overlap. The integer
of silence is in every pause of every recording and says nothing of where they line up, so
it casts no vote; its frames count in the overlap like any other.

Null audio has no fingerprint and no class. Audio too short for one frame has an empty
fingerprint, is a class by itself and matches nothing. Rows with equal audio, whatever their
media_id, share a class; media_ids may repeat or be null (a class of null ids alone has none
and is not searched). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE = 4000
FRAME = 512
HOP = 128
WIDTH = 16  # frames that one integer looks at
CUTS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
LOW_HZ, HIGH_HZ = 110.0, 1760.0


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, from a rule."""
    shapes = [(kind, height, width) for width in (16, 8) for height in (3, 4) for kind in (0, 1, 2, 3)]
    return [(kind, (5 * k) % (13 - height), height, width) for k, (kind, height, width) in enumerate(shapes)]


FILTERS = _filters()


def _classes() -> tuple[np.ndarray, np.ndarray]:
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    bins = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    return bins, np.round(12 * np.log2(hz[bins] / 440.0)).astype(int) % 12


BINS, CLASS_OF_BIN = _classes()
TO_CLASS = (CLASS_OF_BIN[:, None] == np.arange(12)[None, :]).astype(np.float32)
HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of length one (or zero if silent)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * HANN
    energy = np.abs(np.fft.rfft(frames, axis=1)[:, BINS]) ** 2
    out = energy @ TO_CLASS
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that has WIDTH frames from it on."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(t: int, y: int, width: int, height: int) -> np.ndarray:
        a, b = at + t, at + t + width
        return total[b, y + height] - total[a, y + height] - total[b, y] + total[a, y]

    out = np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        whole = box(0, y, width, height)
        if kind == 0:  # the rectangle against the rest of its frames
            part, rest = whole, (box(0, 0, width, 12) - whole) * height / (12 - height)
        elif kind == 1:  # its first half in time
            part = box(0, y, width // 2, height)
            rest = whole - part
        elif kind == 2:  # its lower classes
            part = box(0, y, width, height // 2)
            rest = (whole - part) * (height // 2) / (height - height // 2)
        else:  # its middle in time
            part = box(width // 4, y, width // 2, height)
            rest = whole - part
        level = np.digitize(np.log1p(np.maximum(part, 0)) - np.log1p(np.maximum(rest, 0)), CUTS)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


SILENCE = fingerprint(np.zeros(FRAME + (WIDTH - 1) * HOP, np.float32))[0]


def fingerprints(media: DataFrame, audio: str = "audio", key: str = "media_id") -> DataFrame:
    """(key, fp) of every row; fp holds the integers as little-endian bytes, null without audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                found = [None if x is None else fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2").astype(np.float32)).astype("<u4").tobytes() for x in part.column(audio).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found, pa.binary())], [key, "fp"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, audio).mapInArrow(run, f"{key} {kind}, fp binary")


def sonified(vectors: DataFrame, note_samples: int = 256) -> DataFrame:
    """(media_id, audio): each vector of (vec_id, embedding) played as a row of notes.

    A component's size among 24 steps of a semitone is its note; a null vector has no audio.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(note_samples) / RATE
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                out = []
                for v in part.column("embedding").to_pylist():
                    if v is None:
                        out.append(None)
                        continue
                    x = np.nan_to_num(np.array([0.0 if c is None else c for c in v], np.float64))
                    scale = np.abs(x).max() if len(x) else 0.0
                    step = np.floor((x / scale if scale else x) * 12).astype(int) + 12
                    tone = 220.0 * 2 ** (step / 12)
                    out.append((8000 * np.sin(2 * np.pi * tone[:, None] * t[None, :])).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(out, pa.binary())], ["media_id", "audio"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"media_id {kind}, audio binary")


def rerecorded(media: DataFrame, skip: int = 10 * HOP, gain: float = 0.7, noise: float = 50.0) -> DataFrame:
    """(media_id, audio) of a second recording of each row: begun late, softer, with noise; ids are -1 - id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                ids, out = part.column("media_id").to_pylist(), []
                for i, x in zip(ids, part.column("audio").to_pylist(), strict=True):
                    if x is None:
                        out.append(None)
                        continue
                    own = np.frombuffer(x, "<i2")[skip:] * gain
                    out.append(np.clip(own + np.random.default_rng(abs(i or 0)).normal(0, noise, len(own)), -32768, 32767).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([None if i is None else -1 - i for i in ids], part.column("media_id").type), pa.array(out, pa.binary())], ["media_id", "audio"])

    return media.select("media_id", "audio").mapInArrow(run, f"media_id {media.schema['media_id'].dataType.simpleString()}, audio binary")


def _entries(fps: DataFrame) -> DataFrame:
    """(class_id, word, at): the integers of each class with their frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(x, "<i4") for x in batch.column("fp").to_pylist()]
            at = [np.flatnonzero(w != SILENCE.astype(np.int32)).astype(np.int32) for w in words]
            words = [w[k] for w, k in zip(words, at, strict=True)]
            n = np.array([len(w) for w in words], np.int64)
            at = np.concatenate(at) if len(n) else np.zeros(0, np.int32)
            own = batch.column("class_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(words) if words else np.zeros(0, np.int32)), pa.array(at)], ["class_id", "word", "at"])

    kind = fps.schema["class_id"].dataType.simpleString()
    return fps.select("class_id", "fp").mapInArrow(run, f"class_id {kind}, word int, at int")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap in frames and share of differing bits when frame i of a meets i - offset of b."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    differ = np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()
    return hi - lo, float(differ) / (32 * (hi - lo))


def align(classes: DataFrame, queries: DataFrame, min_votes: int = 4, min_overlap: int = 40, max_error: float = 0.25) -> DataFrame:
    """(class_id, match_id, offset, votes, overlap, bit_error) of the query classes' matches.

    ``classes`` and ``queries`` have (class_id, fp), one row a class.
    """
    entries = _entries(classes.where("fp is not null"))
    asked = _entries(queries.where("fp is not null")).select(F.col("class_id").alias("query"), "word", F.col("at").alias("query_at"))
    votes = (
        asked.join(entries, "word").where("query <> class_id")
        .groupBy("query", "class_id", (F.col("query_at") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
        .groupBy("query", "class_id").agg(F.max(F.struct("votes", (-F.col("offset")).alias("back"))).alias("best"))
        .where(F.col("best.votes") >= min_votes)
        .select("query", "class_id", (-F.col("best.back")).alias("offset"), F.col("best.votes").alias("votes"))
    )
    both = (
        votes.join(queries.select(F.col("class_id").alias("query"), F.col("fp").alias("a")), "query")
        .join(classes.select("class_id", F.col("fp").alias("b")), "class_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bit_errors(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), o) for a, b, o in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("class_id"), batch.column("offset"), batch.column("votes"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())],
                ["class_id", "match_id", "offset", "votes", "overlap", "bit_error"],
            )

    kind = classes.schema["class_id"].dataType.simpleString()
    found = both.select("query", "class_id", "offset", "votes", "a", "b").mapInArrow(run, f"class_id {kind}, match_id {kind}, offset int, votes long, overlap int, bit_error double")
    return found.where((F.col("overlap") >= min_overlap) & (F.col("bit_error") <= max_error))


def search(media: DataFrame, asked: Column, **options) -> DataFrame:
    """(media_id, class_id, n_frames, fp_sha256, is_query, n_matches, match_id, ...) of every row.

    ``asked`` is the condition on media_id of the queries. ``n_matches`` counts the classes
    that a query's class aligns with; of the one with the least bit error (then least id),
    match_id, offset, votes, overlap and bit_error follow. ``align`` gives all pairs.
    """
    fps = fingerprints(media).withColumn("digest", F.sha2("fp", 256)).withColumn("is_query", F.coalesce(asked, F.lit(False)))
    fps = materialize(fps, "audio-fp")
    filled = fps.where(F.length("fp") > 0)
    grouped = materialize(
        filled.groupBy("digest").agg(F.min("media_id").alias("class_id"), F.max("is_query").alias("asked"), F.first("fp").alias("fp")), "audio-classes"
    )
    named = grouped.where("class_id is not null")
    links = align(named, named.where("asked"), **options)
    best = links.groupBy("class_id").agg(F.count("*").alias("n_matches"), F.min(F.struct("bit_error", "match_id", "offset", "votes", "overlap")).alias("best"))
    by_digest = grouped.select("digest", "class_id").join(best, "class_id", "left")
    return fps.join(by_digest, "digest", "left").select(
        "media_id", F.when(F.length("fp") > 0, F.col("class_id")).when(F.col("fp").isNotNull(), F.col("media_id")).alias("class_id"),
        F.coalesce(F.length("fp") / 4, F.lit(0)).cast("long").alias("n_frames"), F.col("digest").alias("fp_sha256"), "is_query",
        F.when(F.col("is_query"), F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        *[F.when(F.col("is_query"), F.col(f"best.{c}")).alias(c) for c in ("match_id", "offset", "votes", "overlap", "bit_error")],
    )
