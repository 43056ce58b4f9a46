"""Five-stage clean-up of ``documents``: each stage's kept rows are the next one's input."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel import storage
from tessel.llm import decontaminate, jaccard_join, line_templates, sentencepiece_codec, toxicity
from tessel.llm.common import held_out_bucket, load

MAX_TOXICITY = 0.7
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables = threading.local()


def stage(f: Stage) -> Stage:
    """A stage that first removes the tables which the stage before left in this thread.

    Nothing reads these any more: a stage gets the rows that its predecessor has written.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.release(getattr(_tables, "paths", []))
        with storage.owned([]) as _tables.paths:
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below MAX_TOXICITY; fitted on the labelled rows of ``documents``."""
    labelled = load(spark, sf_dir, "documents")
    model = toxicity.train(labelled, load(spark, sf_dir, "labels"), held_out_bucket("doc_id", 3) != 1)
    return toxicity.keep_below(docs, model, MAX_TOXICITY)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars`` follows the text."""
    done = line_templates.drop_recurring_lines(docs)
    changed = F.when(F.col("dropped_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 of 100 five-word shingles."""
    return jaccard_join.keep_one(docs, words=5, num=80, den=100)


@stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and the check that these decode to the text."""
    return sentencepiece_codec.encode_documents(docs, check="round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece", encode),
]

ORACLE_SQL = None  # SQL has no fitted classifier; tests/llm/test_pipeline.py holds the rows against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = load(spark, sf_dir, "documents"), None
    for name, one in STAGES[:-1]:
        docs = storage.materialize(one(spark, docs, sf_dir), name.replace(" ", "-"))
        storage.discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
