"""Merkle manifest of a dataset by Pregel-style supersteps (operator 12).

A row is a leaf: the digest of its fields. The leaves of a source, ascending by id, are the
lowest vertices of a tree; every ``fanout`` consecutive ones have a parent. In a superstep
up, each vertex sends its digest to its parent, and a parent that has heard of all its
children hashes them and is a vertex of the next superstep; a vertex alone in its tree is
the source's subroot, and the subroots make one more tree. In the reverse supersteps each
vertex sends its children the way to the root: the place and the siblings of every level
above. The last of them hands one message to all children of a vertex at once, and each leaf
folds its way up to the root, from a second digest where one is given.

Supersteps are RDD shuffles keyed by (source number, vertex number); a message is a digest,
or a way of at most ``fanout - 1`` digests a level, so no task holds more of a tree than one
vertex's children. What the driver holds is one row of sums for each partition of the sorted
leaves, with which these get their numbers. A lost executor's part is computed again from
the written leaves.

Null ids come first in their source and null sources first of all; rows of equal source and
id are ordered by leaf, and those alike in all three are interchangeable. Null fields count
as ``-``, empty and long texts as they are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

FANOUT = 16
Digest = bytes
Way = tuple[tuple[int, tuple[Digest, ...]], ...]  # (place, digests of the run without one's own) of each level
Key = tuple[int, int]


def record_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def hashed(digests: tuple[Digest, ...]) -> Digest:
    """SHA-256 of digests, joined as hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Sums(NamedTuple):
    """What a partition of the sorted leaves says of its sources."""

    rows: int
    sources: int  # runs of one source each
    first: str | None
    last: str | None
    head: int  # rows of the first source
    tail: int  # rows of the last source
    longest: int


class Start(NamedTuple):
    """Where a partition's rows lie: numbers of its first and last source, the first row's place, and both sources' sizes."""

    source: int
    last: int
    place: int
    head: int
    tail: int


def _sums(part: int, rows: Iterator) -> Iterator[tuple[int, Sums]]:
    total = runs = head = run = longest = 0
    first = last = None
    for row in rows:
        if not total or row.source != last:
            head = run if runs == 1 else head
            runs, run, last = runs + 1, 0, row.source
            first = row.source if not total else first
        total, run = total + 1, run + 1
        longest = max(longest, run)
    if total:
        yield part, Sums(total, runs, first, last, run if runs == 1 else head, run, longest)


def _starts(sums: list[tuple[int, Sums]]) -> tuple[dict[int, Start], int, int]:
    """Each partition's Start, the number of sources and the size of the largest."""
    sizes: list[int] = []  # of the sources that a partition begins or ends with, in order
    found: list[tuple[int, int, int, int, int, int]] = []
    before: Sums | None = None
    source, place = -1, 0
    for part, one in sorted(sums):
        if before is not None and before.last == one.first:
            sizes[-1] += one.head
        else:
            sizes.append(one.head)
            source, place = source + 1, 0
        head, last = len(sizes) - 1, source + one.sources - 1
        if one.sources > 1:
            sizes.append(one.tail)
        found.append((part, source, last, place, head, len(sizes) - 1))
        place = place + one.rows if one.sources == 1 else one.tail
        source, before = last, one
    starts = {part: Start(first, last, at, sizes[h], sizes[t]) for part, first, last, at, h, t in found}
    return starts, source + 1, max([0, *sizes, *(one.longest for _, one in sums)])


def _numbered(leaves: RDD, starts: dict[int, Start]) -> RDD:
    """((source number, place), (size of the source, row)) of every leaf.

    Only rows of a source that lies within one partition wait there until it is counted.
    """

    def number(part: int, rows: Iterator) -> Iterator:
        if part not in starts:
            return
        start = starts[part]
        edge = {start.last: start.tail, start.source: start.head}
        number, place = start.source, start.place
        waiting: list = []
        before = None
        for k, row in enumerate(rows):
            if k and row.source != before:
                for i, one in enumerate(waiting):
                    yield (number, i), (len(waiting), one)
                waiting, number, place = [], number + 1, 0
            before = row.source
            if number in edge:
                yield (number, place), (edge[number], row)
                place += 1
            else:
                waiting.append(row)

    return leaves.mapPartitionsWithIndex(number)


class Vertex(NamedTuple):
    """A vertex: how many its level has in its tree, its digest and its children's."""

    level_size: int
    digest: Digest
    children: tuple[Digest, ...]


def _vertex(i: int, heard: Iterable[tuple[int, int, Digest]], fanout: int) -> Vertex:
    """The vertex number ``i`` of its level from its children's messages (place, level size, digest)."""
    heard = sorted(heard)
    size = heard[0][1]
    children = tuple(digest for _, _, digest in heard)
    if len(children) != min(fanout, size - fanout * i):
        raise ValueError(f"a parent has heard of {len(children)} children")
    return Vertex(-(-size // fanout), hashed(children), children)


def _vertices(groups: RDD, fanout: int) -> RDD:
    """Vertices by (tree, number) from the grouped messages of their children."""
    return groups.mapPartitions(lambda part: ((key, _vertex(key[1], heard, fanout)) for key, heard in part), preservesPartitioning=True)


def _messages(level: RDD, fanout: int) -> RDD:
    """What the vertices of a level send their parents; one alone in its tree sends nothing."""
    return level.filter(lambda item: item[1].level_size > 1).map(lambda item: ((item[0][0], item[0][1] // fanout), (item[0][1] % fanout, item[1].level_size, item[1].digest)))


def _steps(size: int, fanout: int) -> int:
    steps = 0
    while size > 1:
        size, steps = -(-size // fanout), steps + 1
    return steps


def _climb(groups: RDD, size: int, fanout: int) -> list[RDD]:
    """The levels of trees of at most ``size`` leaves, above these, from the leaves' grouped messages."""
    levels = [_vertices(groups, fanout)]
    for _ in range(_steps(size, fanout) - 1):
        fewer = max(1, -(-levels[-1].getNumPartitions() // 4))
        levels.append(_vertices(_messages(levels[-1], fanout).groupByKey(fewer), fanout))
    return levels


def _to_children(item, fanout: int) -> Iterator:
    """The messages of one vertex in a reverse superstep: (subroot, way) for each child."""
    (tree, i), (vertex, (subroot, way)) = item
    for k in range(len(vertex.children)):
        yield (tree, fanout * i + k), (subroot, (_own(vertex, k), *way))


def _own(vertex: Vertex, place: int) -> tuple[int, tuple[Digest, ...]]:
    return place, vertex.children[:place] + vertex.children[place + 1 :]


def _descend(levels: list[RDD], begun: RDD, fanout: int) -> RDD:
    """Ways of the lowest of ``levels``, by (tree, number).

    ``begun`` has (tree, (level, subroot, way)): where a tree ends, and the way on from there.
    """
    ways = None
    for n in range(len(levels), 0, -1):
        arriving = begun.filter(lambda item, n=n: item[1][0] == n).map(lambda item: ((item[0], 0), item[1][1:]))
        ways = arriving if ways is None else ways.union(arriving)
        if n > 1:
            level = levels[n - 1]
            ways = level.join(ways.partitionBy(level.getNumPartitions()), level.getNumPartitions()).flatMap(lambda item: _to_children(item, fanout))
    return ways


def fold(digest: Digest, way: Way) -> Digest:
    """The root that a digest and its way lead to."""
    for place, others in way:
        digest = hashed((*others[:place], digest, *others[place:]))
    return digest


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Digests, proofs and checks of (doc_id, source, leaf, found): one row for each of ``rows``.

    ``leaf`` and ``found`` are hex digests: as recorded, and of the row as it is found now
    (null: as recorded). Result: doc_id, source, leaf, subroot, root, proof_sha256 (digest of
    all siblings up to the root, level by level), folded_root (from found) and verified.
    """
    spark = rows.sparkSession
    written = materialize(rows.select("doc_id", "source", "leaf", "found"), "manifest-leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.monotonically_increasing_id().asc()]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = written.repartitionByRange(parts, *order).sortWithinPartitions(*order[:3])
    leaves = ordered.rdd
    starts, sources, longest = _starts(leaves.mapPartitionsWithIndex(_sums).collect())
    schema = T.StructType([rows.schema["doc_id"], rows.schema["source"], *T._parse_datatype_string("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    if not starts:
        return spark.createDataFrame([], schema)

    # up: the first messages carry the leaf's row, so that it waits at its parent for the way down
    numbered = _numbered(leaves, starts)
    members = numbered.filter(lambda item: item[1][0] > 1).map(lambda item: ((item[0][0], item[0][1] // fanout), (item[0][1] % fanout, item[1][0], bytes.fromhex(item[1][1].leaf), tuple(item[1][1])))).groupByKey(parts)
    lone = numbered.filter(lambda item: item[1][0] == 1).map(lambda item: (item[0][0], tuple(item[1][1])))
    levels = _climb(members.mapValues(lambda rows: [row[:3] for row in rows]), longest, fanout) if longest > 1 else []
    subroots = lone.mapValues(lambda row: (0, bytes.fromhex(row[2])))
    for n, level in enumerate(levels, 1):
        subroots = subroots.union(level.filter(lambda item: item[1].level_size == 1).map(lambda item, n=n: (item[0][0], (n, item[1].digest))))
    subroots = subroots.partitionBy(max(1, -(-parts // 4)))

    # the tree of the subroots, up and down again
    if sources > 1:
        heard = subroots.map(lambda item: ((-1, item[0] // fanout), (item[0] % fanout, sources, item[1][1])))
        top = _climb(heard.groupByKey(subroots.getNumPartitions()), sources, fanout)
        root = top[-1].first()[1].digest
        runs = top[0].join(_descend(top, spark.sparkContext.parallelize([(-1, (len(top), root, ()))], 1), fanout))
        onwards = runs.flatMap(lambda item: _to_children(item, fanout)).map(lambda item: (item[0][1], item[1][1]))
        begun = subroots.join(onwards).mapValues(lambda v: (*v[0], v[1]))
    else:
        root = subroots.first()[1][1]
        begun = subroots.mapValues(lambda v: (*v, ()))

    # down to the leaves: one message for all leaves of a vertex, or for a leaf alone in its source
    def answer(row: tuple, subroot: Digest, way: Way) -> tuple:
        doc_id, source, leaf, found = row
        siblings = tuple(d for _, others in way for d in others)
        folded = fold(bytes.fromhex(found or leaf), way)
        return doc_id, source, leaf, subroot.hex(), root.hex(), hashed(siblings).hex(), folded.hex(), folded == root

    def run_answers(item) -> Iterator[tuple]:
        (_, i), (rows, (subroot, way)) = item
        vertex = _vertex(i, (row[:3] for row in rows), fanout)
        for place, _, _, row in rows:
            yield answer(row, subroot, (_own(vertex, place), *way))

    answers = lone.join(begun.filter(lambda item: item[1][0] == 0), parts).map(lambda item: answer(item[1][0], *item[1][1][1:]))
    if levels:
        ways = _descend(levels, begun, fanout).partitionBy(parts)
        answers = answers.union(members.join(ways, parts).flatMap(run_answers))
    return spark.createDataFrame(answers, schema, verifySchema=False)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text as a second copy has it: A-Z lower-cased where 5 divides the id's CRC-32."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, lowered).otherwise(text)


def audit_documents(documents: DataFrame, found_text: Column) -> DataFrame:
    """Manifest of (doc_id, source, lang, n_chars, text) checked against another copy's texts."""
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = documents.select(
        "doc_id", "source", record_digest(*head, F.col("text")).alias("leaf"),
        F.when(found_text.eqNullSafe(F.col("text")), None).otherwise(record_digest(*head, found_text)).alias("found"),
    )
    return manifest(rows)
