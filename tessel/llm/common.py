"""Shared helpers of the corpus operators: tables, written checkpoints, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize
from . import textnum

__all__ = ["connected_components", "discard", "held_out_bucket", "labelled_sample", "load", "materialize", "release", "tidy"]

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Pass) -> Pass:
    """An Arrow pass whose Python worker keeps little memory while it waits for its next task."""

    @functools.wraps(run)
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            textnum.forget_powers()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return passing


def release() -> None:
    """Hand freed memory of the driver's Python back to the system (where that is possible)."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out_bucket(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, train, max_per_class: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``max_per_class`` labelled rows of each class.

    ``train`` is the condition on doc_id that admits a row to training. The bound is on
    rows per class, taken by the smallest hash of doc_id, so the same rows are taken
    whatever the partitioning; a doc_id labelled twice counts once, by its highest label.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    picked = None
    for value in (0, 1):
        part = (
            known.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(max_per_class)
        )
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * max_per_class rows of two numbers: bounded by the parameter
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the least node reachable.

    Least-label propagation with pointer jumping; each round is one joined aggregate with
    map-side combining, written to the shared folder. Star-shaped inputs end in a few
    rounds, a path of length L in about log L. The caller discards the labels.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a is not null and b is not null"), f"{tag}-edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(
        F.col("a").alias("node"), "label"
    )
    labels = materialize(labels, f"{tag}-labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        step = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        # pointer jumping: the label of the label's own node
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        step = materialize(
            step.join(up, "low", "left").select(
                "node", F.least("low", F.coalesce("top", "low")).alias("label"),
                (F.least("low", F.coalesce("top", "low")) < F.col("label")).alias("moved"),
            ),
            f"{tag}-labels",
        )
        discard(labels)
        moved = step.where("moved").limit(1).count() > 0
        labels = step.select("node", "label")
        labels.written_path = step.written_path
        if not moved:
            discard(both)
            return labels
