"""Queries of the corpus operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_fingerprint, byte_bpe, decontaminate, filter_audit, jaccard_join, line_templates, lm_scoring, merkle_manifest, quality, secrets, sentencepiece_codec, toxicity, warc_fixity
from .common import held_out_bucket, load, materialize
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def replica_index(pages: DataFrame) -> DataFrame:
    """The index of a second copy of the archives with known faults, by page id, hashed from its own bytes.

    Records are altered in a byte, lost, or there twice.
    """
    place = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(500))
    sound = warc_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    stored = F.when(place == 3, F.overlay(sound, F.lit("0"), F.lit(8))).otherwise(sound)
    index = warc_fixity.archive_index(pages, record=stored)
    kept = index.where(place != 77).select("archive", "offset", "leaf")
    return kept.unionByName(index.where(place == 200).select("archive", (F.col("offset") + 1).alias("offset"), "leaf"))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every WARC record of ``pages`` with what the audit of a damaged replica says of it."""
    pages = load(spark, sf_dir, "pages")
    index = materialize(warc_fixity.archive_index(pages), "warc-index")
    replica = materialize(replica_index(pages), "warc-replica")
    return warc_fixity.audit(index, replica).select(
        "page_id", "archive", "offset", "length", F.col("leaf").alias("record_sha256"), F.col("other").alias("found_sha256"), "status"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: base patterns, and tokens that the models call random."""
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"), model)
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    kinds = F.transform("secrets", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in range(4)]
    return found.select(
        "doc_id", n[0].alias("n_assign"), n[1].alias("n_access"), n[2].alias("n_hex"),
        F.sha2(secrets.described(base), 256).alias("base_sha256"), secrets.described(F.col("secrets")).alias("spans"),
        n[3].alias("n_random"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document (3 words, 90 of 100)."""
    return jaccard_join.components(load(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, with the check that they decode to it."""
    return sentencepiece_codec.round_trip(load(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows whose remainder is 0 are held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.train(docs, labels, held_out_bucket("doc_id", 5) != 0)
    return quality.score_documents(docs, model).select(
        "doc_id",
        F.coalesce(held_out_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows whose remainder is 1 are held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, held_out_bucket("doc_id", 3) != 1)
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        F.coalesce(held_out_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    done = line_templates.drop_recurring_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "dropped_lines", "is_copy", F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"), "text",
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, with its edit distance."""
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text; rows whose remainder is 2 are held out."""
    docs = load(spark, sf_dir, "documents")
    held_out = held_out_bucket("doc_id", 7) == 2
    scored = lm_scoring.score_documents(docs, ~held_out)
    return scored.withColumn("held_out", F.coalesce(held_out, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint class and best match of every recording; ids divisible by 20 are queries.

    The recordings are all vectors played as notes and, with negative ids, second recordings
    (late, softer, noisy) of every fifth of them.
    """
    played = audio_fingerprint.sonified(load(spark, sf_dir, "embeddings"))
    media = played.unionByName(audio_fingerprint.rerecorded(played.where("media_id % 5 = 0")))
    return audio_fingerprint.search(media, F.col("media_id") % 20 == 0).withColumnRenamed("media_id", "vec_id")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's token ids and of the bytes that they decode to."""
    return byte_bpe.digests(load(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents``, checked against a copy with lower-cased texts."""
    checked = merkle_manifest.audit_documents(load(spark, sf_dir, "documents"), merkle_manifest.tampered(F.col("text"), F.col("doc_id")))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source of ``documents``, in all 120 orders."""
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secrets": op3_secrets,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_line_templates": op7_line_templates,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_audio_fingerprint": op10_audio_fingerprint,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}
