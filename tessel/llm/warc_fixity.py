"""Merkle fixity audit of WARC replicas (operator 1).

Each archive has a tree over its records: a record's leaf is the SHA-256 of its bytes; the
leaves of one range of offsets (``range_bytes`` long) are hashed in the order of their
offsets into a node, ``fanout`` neighbouring ranges into the node above, and so on for
``levels`` levels; the nodes of the top level give the archive's root. A node says where
its children lie, so a record that moves changes it.

Two replicas are compared from their roots down: at each level only the children of nodes
that differ are looked at, so the records of intact archives are never compared. At the
bottom a record is ``changed``, ``missing`` (from the second replica) or ``extra`` there.

A range holds at most ``range_bytes`` / shortest record leaves and a node below the root
``fanout`` children; the root hashes one node for each ``range_bytes * fanout ** (levels - 1)``
bytes of its archive, so archives far beyond a GB want more ``levels``. Only hashes are
shuffled. Null text fields of a page count as empty. Rows without a page id get archives of
their own by their content; rows that are the same are records one after the other, in one
archive and one window, however many they are. No pages give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RANGE_BYTES = 1 << 16
FANOUT = 16
LEVELS = 3


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The response record of a page as text; lines end as WARC/1.1 has it."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive_index(pages: DataFrame, pages_an_archive: int = 1000, record: Column | None = None) -> DataFrame:
    """(page_id, archive, offset, length, leaf): where each page's record lies.

    Archives hold consecutive page ids. Offsets are running sums of record lengths; a leaf
    hashes the bytes of ``record``, a page's WARC record unless given.
    """
    if record is None:
        record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    own = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40))
    rows = pages.select(
        "page_id",
        F.coalesce(F.floor(F.col("page_id") / pages_an_archive), own).cast("long").alias("archive"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("leaf"),
    )
    # an archive has a fixed number of page ids, so the window is bounded
    order = Window.partitionBy("archive").orderBy("page_id", "leaf", "length").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def tree(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(level, archive, node, hash) from leaves (archive, offset, leaf).

    Level 1 are ranges of offsets; the level after the last is the root, its node 0.
    """
    out, below = None, leaves.select("archive", F.col("offset").alias("place"), F.col("leaf").alias("hash"))
    for level in range(1, levels + 2):
        step = range_bytes if level == 1 else fanout
        node = F.lit(0).cast("long") if level == levels + 1 else F.floor(F.col("place") / step).cast("long")
        below = (
            below.withColumn("node", node).groupBy("archive", "node")
            .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat_ws(":", x["place"], x["hash"])), ","), 256).alias("hash"))
        )
        own = below.select(F.lit(level).alias("level"), "archive", "node", "hash")
        out = own if out is None else out.unionByName(own)
        below = below.select("archive", F.col("node").alias("place"), "hash")
    return out


def differing_leaves(
    first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """(archive, offset, leaf, other, status) of the records in which two replicas differ.

    Both have (archive, offset, leaf). Archives that only one replica has differ as a whole.
    """
    trees = [materialize(tree(x, range_bytes, fanout, levels), "merkle") for x in (first, second)]
    level_of = lambda t, k: t.where(F.col("level") == k).select("archive", "node", "hash")
    suspects = None
    for level in range(levels + 1, 0, -1):
        a, b = (level_of(t, level) for t in trees)
        if suspects is not None:
            up = F.lit(0).cast("long") if level == levels else F.floor(F.col("node") / fanout).cast("long")
            a, b = (
                x.withColumn("above", up).join(suspects.select("archive", F.col("node").alias("above")), ["archive", "above"], "left_semi").drop("above")
                for x in (a, b)
            )
        both = a.join(b.withColumnRenamed("hash", "other"), ["archive", "node"], "full_outer")
        suspects = materialize(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node"), "merkle-suspects")
    a, b = (
        x.select("archive", "offset", "leaf").withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long"))
        .join(suspects, ["archive", "node"], "left_semi").drop("node")
        for x in (first, second)
    )
    both = a.join(b.withColumnRenamed("leaf", "other"), ["archive", "offset"], "full_outer")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("leaf").isNull(), "extra").otherwise("changed")
    return both.where(~F.col("leaf").eqNullSafe(F.col("other"))).withColumn("status", status)


def audit(first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """Every record of ``first`` with its ``status``, and the extra ones of ``second``."""
    found = differing_leaves(first, second, **options).select("archive", "offset", "other", "status")
    kept = first.join(found, ["archive", "offset"], "full_outer")
    return kept.withColumn("status", F.coalesce("status", F.lit("intact")))
