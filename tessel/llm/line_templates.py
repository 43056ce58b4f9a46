"""Line deduplication with a log-template tree (operator 7); DataFrame functions only.

Each line of each document goes down a tree of fixed depth: its token count, then its
leading tokens, with tokens that hold a digit generalised to ``<*>`` first. In a leaf with
several line texts, how often a token stands at its place tells constants from variable
fields: at a level, tokens found there in fewer lines than the level are fields, and what is
left of a line is its template. Levels rise from the least number of texts by LEVEL_STEP
to the size of the largest leaf, so one leaf can hold several templates, rare ones beside
frequent ones, and fields whose values recur. A template needs ``min_constant`` of its
positions constant, and half of those below its path through the tree. Positions are rows,
so lines may have any number of tokens.

A template found in at least ``min_docs`` different texts (``min_docs_long`` for lines of
``long_tokens`` and more) recurs, and its lines are dropped from every document. Exact copies
of a whole text count once. A text whose recurring lines make up more than ``copy_share`` of
it, and more than that in common with one other text, is a copy of that text rather than a
page with boilerplate: it is marked ``is_copy`` and stays whole, for document deduplication.

Lines are cut at newlines; blank lines and lines of variable fields alone are kept. Null
text: stays null, no lines. Empty text: one blank line. Rows with equal texts lose the same
lines, whatever their doc_id; a null doc_id is like any other. Order of lines is kept; a
document without dropped lines is returned unchanged. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

VARIABLE = r"[^ ]*[0-9][^ ]*"
LEVEL_STEP = 8
SALTS = 8


def dealt(lines: DataFrame) -> DataFrame:
    """``lines`` with a salt of their text, so that one key's lines meet in SALTS tasks."""
    return lines.withColumn("salt", F.pmod("copy", F.lit(SALTS)).cast("int"))


def for_all_salts(keys: DataFrame) -> DataFrame:
    """One row for each salt of each row of ``keys``, the side with one row a key."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def masked(line: Column) -> Column:
    """The line, trimmed and with single blanks, tokens with digits as ``<*>``."""
    blank = F.when(line.contains("  ") | line.rlike(r"[\t\x0B\f\r]"), F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)
    trimmed = F.trim(blank)
    return F.when(trimmed.rlike("[0-9]"), F.regexp_replace(trimmed, VARIABLE, "<*>")).otherwise(trimmed)


def lines_of(docs: DataFrame, depth: int = 3) -> DataFrame:
    """(copy, whole, pos, chars, masked, n_tokens, key, leaf) of every line with a token of its own.

    ``copy`` hashes the text, ``key`` the masked line, ``leaf`` its path through the tree.
    """
    return (
        docs.select(F.xxhash64("text").alias("copy"), F.length("text").alias("whole"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("copy", "whole", "pos", F.length("line").alias("chars"), masked(F.col("line")).alias("masked"))
        .withColumn("n_tokens", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
        .withColumn("key", F.xxhash64("masked"))
        .withColumn("leaf", F.xxhash64("n_tokens", F.substring_index("masked", " ", depth)))
    )


def general_keys(lines: DataFrame, by_key: DataFrame, need: Column, depth: int, min_docs: int, min_constant: float, min_tokens: int) -> DataFrame:
    """Keys of the lines that fit a recurring template with variable fields."""
    leaves = materialize(
        by_key.where(F.col("n_tokens") >= min_tokens).groupBy("leaf", "n_tokens")
        .agg(F.sum("n").alias("leaf_docs"), F.count("*").alias("texts"))
        .where((F.col("leaf_docs") >= need) & (F.col("texts") > 1)).select("leaf", "leaf_docs"),
        "line-leaves",
    )
    texts = materialize(  # hashed; a least string by key would sort all lines
        lines.select("leaf", "key", "masked").join(leaves.select("leaf"), "leaf", "left_semi").distinct()
        .join(by_key, ["leaf", "key"]).select("leaf", "key", "n", "n_tokens", F.split("masked", " ").alias("tokens")),
        "line-leaf-texts",
    )
    placed = texts.select("leaf", "key", "n", F.posexplode("tokens").alias("pos", "token")).where("token <> '<*>'")
    often = placed.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("often")).where(F.col("often") >= min_docs)
    known = placed.join(often, ["leaf", "pos", "token"]).groupBy("leaf", "key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "often"))).alias("often"))
    largest = leaves.agg(F.max("leaf_docs")).first()[0] or 0
    levels = [min_docs]
    while levels[-1] * LEVEL_STEP <= largest:
        levels.append(levels[-1] * LEVEL_STEP)
    level = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    constant = lambda tok, i: F.when(F.coalesce(F.element_at("often", i), F.lit(0)) >= F.col("level"), tok).otherwise("<*>")
    fixed = F.filter("template", lambda t: t != "<*>")
    templates = (
        texts.join(known, ["leaf", "key"]).select("leaf", "key", "n", "n_tokens", "tokens", "often", level)
        .withColumn("template", F.transform("tokens", constant))
        .withColumn("fixed", F.size(fixed))
        .where(
            (F.col("fixed") >= min_constant * F.col("n_tokens")) & (F.col("fixed") < F.col("n_tokens"))
            & (F.col("fixed") - depth >= 0.5 * (F.col("n_tokens") - depth))
        )
        .select("key", "n", "n_tokens", F.xxhash64("leaf", "template").alias("template")).distinct()
    )
    templates = materialize(templates, "line-templates")
    frequent = (
        templates.groupBy("template", "n_tokens").agg(F.sum("n").alias("docs"), F.count("*").alias("texts"))
        .where((F.col("docs") >= need) & (F.col("texts") > 1)).select("template")
    )
    fitted = templates.join(frequent, "template", "left_semi").select("template", "key", "n_tokens")
    spread = (  # a text with two lines of one template counts once
        lines.select("key", "copy").join(fitted, "key").select("template", "n_tokens", "copy").distinct()
        .groupBy("template", "n_tokens").agg(F.count("*").alias("docs")).where(F.col("docs") >= need)
    )
    keys = materialize(fitted.join(spread.select("template"), "template", "left_semi").select("key").distinct(), "line-general")
    discard(leaves, texts, templates)
    return keys


def recurring_lines(
    docs: DataFrame, min_docs: int = 10, min_docs_long: int = 5, long_tokens: int = 50, depth: int = 3,
    min_constant: float = 0.7, min_tokens: int = 4,
) -> DataFrame:
    """(copy, whole, pos, chars, key) of the lines of recurring templates, each text once."""
    lines = materialize(lines_of(docs, depth).where(F.col("masked").rlike("[^<*> ]")), "lines")  # fields alone are no template
    need = F.when(F.col("n_tokens") >= long_tokens, min_docs_long).otherwise(min_docs)
    by_key = materialize(
        lines.select("leaf", "key", "n_tokens", "copy").distinct().groupBy("leaf", "key", "n_tokens").agg(F.count("*").alias("n")), "line-keys"
    )
    general = general_keys(lines, by_key, need, depth, min(min_docs, min_docs_long), min_constant, min_tokens)
    keys = by_key.where(F.col("n") >= need).select("key").unionByName(general).distinct()
    placed = dealt(lines.select("copy", "whole", "pos", "chars", "key")).join(for_all_salts(keys).hint("merge"), ["key", "salt"], "left_semi")
    found = materialize(placed.select("copy", "whole", "pos", "chars", "key").distinct(), "line-recurring")
    discard(lines, by_key, general)
    return found


def lost_lines(found: DataFrame, copy_share: float) -> DataFrame:
    """(copy, gone, is_copy): the numbers of each text's recurring lines, and whether it copies another.

    Similarity is taken to the first and the last text, by hash, that has a line too.
    """
    lost = found.groupBy("copy").agg(F.collect_list("pos").alias("gone"), F.sum(F.col("chars") + 1).alias("lost"), F.max("whole").alias("whole"))  # a text's lines
    lost = materialize(lost, "line-lost")
    heavy = lost.where(F.col("lost") > copy_share * F.col("whole")).select("copy")
    ends = found.groupBy("key").agg(F.min("copy").alias("a"), F.max("copy").alias("b"))
    shared = (
        dealt(found.join(heavy, "copy", "left_semi").select("copy", "whole", "chars", "key")).join(for_all_salts(ends), ["key", "salt"])
        .select("copy", "whole", "chars", F.explode(F.array_distinct(F.array("a", "b"))).alias("other")).where("copy <> other")
        .groupBy("copy", "whole", "other").agg(F.sum(F.col("chars") + 1).alias("common"))
        .groupBy("copy").agg(F.max(F.col("common") > copy_share * F.col("whole")).alias("is_copy"))
    )
    out = materialize(lost.join(shared, "copy", "left").select("copy", "gone", F.coalesce("is_copy", F.lit(False)).alias("is_copy")), "line-gone")
    discard(lost)
    return out


def drop_recurring_lines(docs: DataFrame, copy_share: float = 0.5, **options) -> DataFrame:
    """``docs`` without the lines of recurring templates, and three columns:

    ``dropped_lines`` and ``n_lines`` (long), and ``is_copy``; they replace columns of these
    names. Other columns are unchanged and may have any names.
    """
    found = recurring_lines(docs.select("text"), **options)
    lost = lost_lines(found, copy_share)
    discard(found)
    spare = lambda name: name if name not in docs.columns else spare(name + "_")
    copy, gone, mark = (spare(x) for x in ("copy_of_text", "gone_lines", "is_a_copy"))
    # the lost lines grow with the corpus, so they are never broadcast
    joined = docs.join(lost.select(F.col("copy").alias(copy), F.col("gone").alias(gone), F.col("is_copy").alias(mark)).hint("merge"), F.xxhash64("text") == F.col(copy), "left")
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    short = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    cut = F.col(gone).isNotNull() & ~F.col(mark) & F.col("text").isNotNull()
    columns = [F.when(cut, short).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ADDED]
    return joined.select(
        *columns, F.when(cut, F.size(gone)).otherwise(0).cast("long").alias("dropped_lines"),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(mark, F.lit(False)).alias("is_copy"),
    )


ADDED = ("dropped_lines", "n_lines", "is_copy")
