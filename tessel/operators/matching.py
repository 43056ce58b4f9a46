"""Pairs within bounded groups, retrieval scores and ordered unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cosine_product, top_pairs


def ordered_pairs(rows: DataFrame, keys: list[str], by: str, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """(keys, by_a, by_b) with by_a < by_b inside each key; the key must bound its group."""
    every = F.lit(True)
    a = rows.where(every if left is None else left).select(*keys, F.col(by).alias(f"{by}_a"))
    b = rows.where(every if right is None else right).select(*keys, F.col(by).alias(f"{by}_b"))
    return a.join(b, keys).where(F.col(f"{by}_a") < F.col(f"{by}_b"))


def between(rows: DataFrame, keys: list[str], by: str, outer: Column, inner: Column) -> DataFrame:
    """(keys, by_a, by_c, by_b): an inner row between two outer ones; both joins share one shuffle."""
    first = rows.where(outer).select(*keys, F.col(by).alias(f"{by}_a"))
    mid = rows.where(inner).select(*keys, F.col(by).alias(f"{by}_c"))
    last = rows.where(outer).select(*keys, F.col(by).alias(f"{by}_b"))
    lower = mid.join(first, keys).where(F.col(f"{by}_a") < F.col(f"{by}_c"))
    return lower.join(last, keys).where(F.col(f"{by}_c") < F.col(f"{by}_b"))


def recent_pairs(rows: DataFrame, order: list[Column], key: str, by: str, pool: int, k: int) -> DataFrame:
    """The first k pairs of equal key among the ``pool`` first rows."""
    recent = rows.orderBy(*order).limit(pool).select(key, by)
    return ordered_pairs(recent, [key], by).orderBy(f"{by}_a", f"{by}_b").limit(k)


def phrase_score(text: Column, phrase: str, importance: Column) -> Column:
    """1 for the whole phrase and .2 for each of its words that the text contains, by .5 + importance."""
    hit = lambda s: F.contains(F.lower(text), F.lit(s)).cast("int")
    words = sum((hit(w) for w in phrase.lower().split()), F.lit(0))
    return (hit(phrase.lower()) + 0.2 * words) * (0.5 + importance)


def task_score(same_kind: Column, same_domain: Column, tokens: Column, asked: Sequence[str]) -> Column:
    """.3 for the kind, .3 for the domain, .4 for the share of asked tokens."""
    share = F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in asked]))) / max(1, len(set(asked)))
    return 0.3 * same_kind.cast("int") + 0.3 * same_domain.cast("int") + 0.4 * share


def merge_ranked(sources: Sequence[tuple[str, DataFrame]], k: int) -> DataFrame:
    """(source, id, text): union of (id, text) in the order given, each trimmed text once, the first k.

    A text's first place is an aggregate by its SHA-256, so that copies combine before the
    shuffle and whole texts stay where they are; the k places kept fetch their texts.
    """
    every = None
    for rank, (name, rows) in enumerate(sources):
        part = rows.where("text is not null").select(F.trim("text").alias("text"), F.struct(F.lit(rank).alias("rank"), F.col("id"), F.lit(name).alias("source")).alias("place"))
        every = part if every is None else every.unionByName(part)
    keyed = every.where("text <> ''").withColumn("key", F.sha2("text", 256))
    best = keyed.groupBy("key").agg(F.min("place").alias("place")).orderBy("place.rank", "place.id").limit(k)
    fetched = keyed.join(F.broadcast(best), ["key", "place"]).dropDuplicates(["key"])  # k rows
    return fetched.orderBy("place.rank", "place.id").select("place.source", "place.id", "text")


def cosine_search(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest of each asked row of (vec_id, embedding) among all others.

    Scores are rounded to four places; of equal ones the least vec_id comes first.
    """
    rows = vectors.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    queries = vectors.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return top_pairs(queries, rows, k, cosine_product, digits=4).withColumnRenamed("row_id", "vec_id")
