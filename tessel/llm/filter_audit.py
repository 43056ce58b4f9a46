"""Interaction audit of five quality filters in every order (operator 13).

Built-in expressions give each text a mask of the filters it fails, and a groupBy of the text
supplies its row of least doc_id, the only one that is no copy. Masks are counted by part, at
most 32 cells each, and all orders of the filters are read off the cells: what comes before a
step removes a cell whole or not at all.

A text is known by its length and SHA-256, so whole texts are not shuffled; both shuffles of
single rows are of some 60 bytes each, and a text or part that many rows have is counted in
parts. A null text counts as empty. A row without doc_id has no smaller one and is smaller
than none, and has no labels. Rows of equal doc_id and text are equal: none is a copy of the
other. A doc_id labelled more than once has a label if any of its rows has it; a null label
is none. A null part is the empty string. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = "ABCDE"
COPY = 1 << NAMES.index("E")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: under 50 words, under 65 % distinct words, over 5 % capitals, special characters."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): 1 where a row of ``labels`` says so, one row a doc_id."""
    yes = lambda c: F.max((F.coalesce(c, F.lit(0)) == 1).cast("int"))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of ``documents`` fail just these filters, and how many of them are labelled."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"),
        F.length(text).alias("length"), F.unhex(F.sha2(text, 256)).alias("sha"),
    )
    zero = F.lit(0)
    known = (
        rows.where("doc_id is not null").join(marked(labels), "doc_id", "left")
        .groupBy("doc_id", "length", "sha", "mask", "part", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
        .agg(F.count("*").alias("n"))
    )
    every = known.select("part", F.col("mask").bitwiseOR(COPY).alias("mask"), "n", "good", "toxic")
    # the rows of a text's least doc_id count as no copies: out of one cell, into the other
    one_id = known.groupBy("doc_id", "length", "sha", "mask", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("places"))
    least = one_id.groupBy("length", "sha").agg(F.min_by(F.struct("mask", "good", "toxic", "places"), "doc_id").alias("first"))
    moved = least.select("first.*").select("mask", "good", "toxic", F.inline("places"))
    moved = moved.select("part", F.inline(F.array(
        F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (-F.col("n")).alias("n")), F.struct(F.col("mask"), F.col("n")),
    )), "good", "toxic")
    # rows without doc_id match nothing: kept out of the joins, where they would meet in one task
    unknown = rows.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    counted = every.unionByName(moved).unionByName(unknown).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    return counted


def orders(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the parts' cells.

    kept: rows left after the step; removed: by it; redundant: failing its filter, removed
    before; unique_fails: failing no other filter; good_lost, toxic_lost: labelled rows among
    removed; shapley: what its filter removes, summed over all orders.
    """
    part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    every = ["".join(p) for p in permutations(NAMES)]
    step = part.select("part", "cells", F.explode(F.lit(every)).alias("filter_order")).select("*", F.explode(F.lit([*range(1, len(NAMES) + 1)])).alias("step"))
    bit = sum((F.when(F.substring("filter_order", F.col("step"), F.lit(1)) == f, 1 << k).otherwise(0) for k, f in enumerate(NAMES)), F.lit(0))
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(NAMES)), F.lit(0))
    step = step.withColumns({"bit": bit, "before": before})

    def total(of: str, which) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, c: a + c[of])

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda c: fails(c) & ~gone(c)
    n_orders = F.lit(len(every)).cast("long")
    # a filter comes first of the k that a cell fails in one k-th of all orders
    shares = F.aggregate(F.filter("cells", fails), F.lit(0).cast("long"), lambda a, c: a + c["n"] * (n_orders / F.bit_count(c["mask"])).cast("long"))
    return step.select(
        "part", "filter_order", "step",
        total("n", lambda c: ~fails(c) & ~gone(c)).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda c: fails(c) & gone(c)).alias("redundant"), total("n", lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(cells(documents, labels))
