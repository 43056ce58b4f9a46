"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets (operator 4).

A document's set holds its distinct word shingles (A-Z lower-cased, words are runs without
white space); a text of fewer words gives its whole sequence as one element, a text without
words the empty set, which links with nothing. Two sets link when
``den * |intersection| >= num * |union|``.

Sets are ordered by one global order, rare elements first. By prefix filtering, sets that
link share an element of their first ``p`` and two of their first ``p + 1`` elements, with
``p = n - ceil(n * num / den) + 1``. Small sets enumerate all two-element subsets of those
``p + 1`` elements; large sets are found by the inverted lists of their first ``p``; small
sets that may link with a large one enter the lists as well. The boundary between small and
large is the power of two of least cost: subsets to write against lists to scan, estimated
on a bounded sample of sets. Neither the order (a count sketch of fixed size over all
documents) nor the boundary changes the result.

Equal sets are one node. Lists are linked without enumerating the pairs of a group: every
member with one hub of its list, twice by another order; then with every 16th set of its
list that is still in another component, and only then all pairs across components that
still meet in a list, by bands of sizes. What links densely is one component before pairs
are enumerated. Bounds that hold
for every linked pair drop proposed pairs early: the sizes; the places of the shared element;
the parities of the element counts in 256 buckets (sets that differ in more of them than
elements may differ cannot link); the element counts in HISTOGRAM buckets (the sum of the
lesser ones bounds the overlap). Every pair left is verified on the whole sets. What is left
out are pairs already in one component, which cannot change the components.

Rows with a null doc_id keep it; their component is the least doc_id that is known in it.
Rows that share a doc_id are taken one by one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from ..storage import drop_shuffles
from .common import connected_components, discard, materialize, tidy

SKETCH_BITS = 20
SKETCH_PARTS = 64
SAMPLE_A_TASK = 32
COST_SAMPLE = 2000
HISTOGRAM = 128
ODD = 4
FILTER_BITS = 23
U64 = np.uint64
ODDS = [f"odd{k}" for k in range(ODD)]
SLICE = 1 << 20
HUBS = (None, None, 16, 1)


def bucket_of(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SKETCH_BITS)).astype(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row's set."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(N.mix(values ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    return N.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64)).view(np.int64)


def histograms(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each row's element counts by HISTOGRAM buckets as 16-bit numbers; 65535 is any number."""
    rows = len(offsets) - 1
    place = np.repeat(np.arange(rows), np.diff(offsets)) * HISTOGRAM + ((values >> U64(20)) % U64(HISTOGRAM)).astype(np.int64)
    counts = np.bincount(place, minlength=rows * HISTOGRAM).reshape(rows, HISTOGRAM)
    return [row.tobytes() for row in np.minimum(counts, 65535).astype(np.uint16)]


def parities(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Parities of each row's element counts in 64 * ODD buckets, as 64-bit numbers."""
    out = []
    for k in range(ODD):
        mine = ((values >> U64(13)) % U64(ODD)) == U64(k)
        sums = np.zeros(len(values) + 1, U64)
        np.bitwise_xor.accumulate(np.where(mine, U64(1) << ((values >> U64(7)) & U64(63)), U64(0)), out=sums[1:])
        out.append((sums[offsets[1:]] ^ sums[offsets[:-1]]).view(np.int64))
    return out


def _fill(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def summaries(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, sig, counts, parities) of every row; sketch parts and sampled sets as rows of other kinds."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        sample: list[tuple[int, bytes]] = []
        names, id_type = ["kind", "doc_id", "n", "sig", "part", "blob", *ODDS], None
        for big in batches:
            id_type = big.column("doc_id").type
            for batch in N.slices(big, max_bytes=SLICE):
                values, offsets = N.row_sets(*N.utf8(batch.column("text")), words)
                sig, n, rows = signatures(values, offsets), np.diff(offsets), batch.num_rows
                counts += np.bincount(bucket_of(values), minlength=1 << SKETCH_BITS)
                for i in np.argsort(sig)[:SAMPLE_A_TASK].tolist():
                    if n[i]:
                        sample.append((int(sig[i]), values[offsets[i] : offsets[i + 1]].tobytes()))
                sample = sorted(dict(sample).items())[:SAMPLE_A_TASK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(rows, np.int32)), batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sig), _fill(rows, pa.int32()), pa.array(histograms(values, offsets), pa.binary()), *[pa.array(x) for x in parities(values, offsets)]],
                    names,
                )
        if id_type is None:
            return
        task = TaskContext.get().partitionId() % 256
        blobs = [(1, task, part, zlib.compress(own.astype(np.int64).tobytes(), 1)) for part, own in enumerate(np.split(counts, SKETCH_PARTS)) if own.any()]
        blobs += [(2, sig, 0, blob) for sig, blob in sample]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b[0] for b in blobs], pa.int32()), _fill(len(blobs), id_type), _fill(len(blobs), pa.int64()), pa.array([b[1] for b in blobs], pa.int64()), pa.array([b[2] for b in blobs], pa.int32()), pa.array([b[3] for b in blobs], pa.binary()), *[_fill(len(blobs), pa.int64()) for _ in ODDS]],
            names,
        )

    return docs.select("doc_id", "text").mapInArrow(run, f"kind int, doc_id {kind}, n long, sig long, part int, blob binary" + "".join(f", {c} long" for c in ODDS))


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the sketch parts of one group, batch by batch."""
    total, sig, part = None, 0, 0
    for batch in batches:
        for blob in batch.column("blob"):
            own = np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
            total = own.copy() if total is None else total + own
        sig, part = batch.column("sig")[0].as_py(), batch.column("part")[0].as_py()
    yield pa.RecordBatch.from_arrays(
        [pa.array([sig], pa.int64()), pa.array([part], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sig", "part", "blob"]
    )


def sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles by bucket: 2**SKETCH_BITS numbers whatever the corpus."""
    parts = rows.where("kind = 1").select("sig", "part", "blob")
    schema = "sig long, part int, blob binary"
    by_task = parts.groupBy("part", "sig").applyInArrow(_sum_parts, schema)
    summed = by_task.groupBy("part").applyInArrow(_sum_parts, schema)
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in summed.collect():  # SKETCH_PARTS rows
        counts[r.part] = np.frombuffer(zlib.decompress(r.blob), np.int64)
    return counts.ravel()


def prefix_lengths(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-n * num // den) + 1


def choose_boundary(rows: DataFrame, counts: np.ndarray, num: int, den: int) -> int:
    """Size from which sets are large: the power of two of least estimated cost."""
    sample = rows.where("kind = 2").orderBy("sig").limit(COST_SAMPLE).select("blob").collect()
    background = counts.sum() / len(counts)
    subsets, lists = np.zeros(40), np.zeros(40)
    for r in sample:
        values = np.frombuffer(r.blob, U64)
        p = int(prefix_lengths(np.array([len(values)]), num, den)[0])
        excess = np.sort(np.maximum(counts[bucket_of(values)] - background, 0))[:p]
        size = int(len(values)).bit_length()
        subsets[size] += p * (p + 1) / 2
        lists[size] += p + excess.sum()
    cost = [subsets[:b].sum() + lists[b:].sum() for b in range(len(lists))]
    return 1 << max(0, int(np.argmin(cost)) - 1)


def postings(docs: DataFrame, counts, boundary: int, words: int, num: int, den: int) -> DataFrame:
    """(key, sig, place): the list entries of every distinct set of a task.

    ``place`` packs the set's size and how many of its elements come before, as most keys
    are met once only and yet all are shuffled.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = counts.value
        seen: set[int] = set()
        for big in batches:
            for batch in N.slices(big, max_bytes=SLICE):
                values, offsets = N.row_sets(*N.utf8(batch.column("text")), words)
                sig, n = signatures(values, offsets), np.diff(offsets)
                new = np.zeros(len(sig), bool)
                # a set that no set of another size or content can reach links with equals only
                alone = (n * den // num == n) & (-(-n * num // den) == n)
                for i in np.flatnonzero((n > 0) & ~alone).tolist():
                    if int(sig[i]) not in seen:
                        seen.add(int(sig[i]))
                        new[i] = True
                owner = np.repeat(np.arange(len(n)), n)
                values, owner = values[new[owner]], owner[new[owner]]
                order = np.lexsort((values, rarity[bucket_of(values)], owner))
                values, owner = values[order], owner[order]
                first = np.searchsorted(owner, np.arange(len(n)))
                pos = np.arange(len(values)) - first[owner]
                p = prefix_lengths(n, num, den)
                lists = (n >= boundary) | (n * den >= num * boundary)
                one = (pos < p[owner]) & lists[owner]
                keys, own, at = [N.mix(values[one] + U64(1))], [owner[one]], [pos[one]]
                for row in np.flatnonzero(new & (n < boundary)).tolist():
                    head = values[first[row] : first[row] + min(n[row], p[row] + 1)]
                    i, j = np.triu_indices(len(head), 1)
                    keys.append(N.mix(head[i] * U64(0x9FB21C651E98DF25) + head[j] + U64(2)))
                    own.append(np.full(len(i), row))
                    at.append(j - 1)  # if these are the first two shared, j - 1 elements are not
                key, row = np.concatenate(keys).view(np.int64), np.concatenate(own)
                place = (n[row].astype(np.int64) << 32) + np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sig[row]), pa.array(place)], ["key", "sig", "place"])

    return docs.select("text").mapInArrow(run, "key long, sig long, place long")


def plausible(pairs: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the element counts (sig, blob) by bucket don't rule out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HISTOGRAM).astype(np.int64) for c in ("x", "y"))
            n = x.sum(1) + y.sum(1)
            any_number = ((x == 65535) | (y == 65535)).any(1)
            keep = any_number | (np.minimum(x, y).sum(1) * (num + den) >= n * num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x = counts.select(F.col("sig").alias("a"), F.col("blob").alias("x"))
    y = counts.select(F.col("sig").alias("b"), F.col("blob").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def fetch_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, elements) of the wanted sets; ``wanted`` has (sig, doc_id of a row with it).

    A bit table of fixed size over the wanted ids spares most other texts; the join on the
    set's own hash is exact.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words_of_bits = (
        wanted.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect()  # at most 2**17 rows
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words_of_bits:
        table[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 1 MB

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for big in batches:
            h = big.column("h").to_numpy(zero_copy_only=False)
            big = big.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            for batch in N.slices(big, max_bytes=SLICE):
                values, offsets = N.row_sets(*N.utf8(batch.column("text")), words)
                elements = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(signatures(values, offsets)), elements], ["sig", "elements"])

    sets = docs.select(place.alias("h"), "text").mapInArrow(run, "sig long, elements array<long>")
    return sets.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    a = sets.select(F.col("sig").alias("a"), F.col("elements").alias("set_a"))
    b = sets.select(F.col("sig").alias("b"), F.col("elements").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (
        pairs.join(a, "a").join(b, "b")
        .withColumn("both", both)
        .where(F.col("both") * den >= (F.size("set_a") + F.size("set_b") - F.col("both")) * num)
        .select("a", "b")
    )


def _may_link(num: int, den: int):
    """Condition on two list entries: sizes, what the places leave over, and the parities."""
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in ODDS)
    least = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")).cast("long")
    return (
        (F.least("n", "n2") * den >= F.greatest("n", "n2") * num)
        & (least * (num + den) >= (F.col("n") + F.col("n2")) * num)
        & (differ * (num + den) <= (F.col("n") + F.col("n2")) * (den - num))
    )


def open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of the lists in which sets of several components still meet, with their labels.

    Components only grow, so a list of one component never opens again; ``members`` go, and
    the frame returned is the written one that takes their place.
    """
    found = labels.select(F.col("node").alias("sig"), F.col("label").alias("found"))
    labelled = members.drop("label").join(found, "sig", "left").withColumn("label", F.coalesce("found", "sig")).drop("found")
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    active = materialize(labelled.join(several, "key", "left_semi"), "jaccard-members")
    discard(members)
    return active


def across(members: DataFrame, other: list, share: int, num: int, den: int) -> DataFrame:
    """The pairs of entries of one list and different labels, of sizes that may link.

    Sizes fall into bands by whole powers of a little more than ``den / num``; sizes that
    may link lie in one band or in neighbouring ones, so a list is met band by band. With a
    ``share`` above one, one side is every ``share``-th set by hash.
    """
    band = F.floor(F.log("n") / math.log(1.0001 * den / num)).cast("int")
    low = members.withColumn("band", band)
    hubs = low.where(F.pmod(F.xxhash64("sig"), F.lit(share)) == 0)
    near = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    once = "label < label2" if share == 1 else "label <> label2"
    return low.join(hubs.select("key", *other, near), ["key", "band"]).where(once)


def components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    if not 0.6 <= num / den <= 1:
        raise ValueError("the similarity must be between 0.6 and 1")
    spark = docs.sparkSession
    rows = materialize(summaries(docs, words), "jaccard-rows")
    sets_of = rows.where("kind = 0").select("doc_id", "n", "sig")
    counts = sketch(rows)
    boundary = choose_boundary(rows, counts, num, den)
    shared = spark.sparkContext.broadcast(counts)  # of fixed size
    entries = materialize(postings(docs, shared, boundary, words, num, den), "jaccard-entries")
    met = entries.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("key")
    met = materialize(met, "jaccard-met")
    drop_shuffles(spark)
    placed = materialize(entries.join(met, "key", "left_semi").groupBy("key", "sig").agg(F.min("place").alias("place")), "jaccard-placed")
    discard(entries, met)
    least = sets_of.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    counted = rows.where("kind = 0").join(placed.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(*[F.first(c).alias(c) for c in ("blob", *ODDS)])
    counted = materialize(counted, "jaccard-counts")
    members = placed.join(counted.select("sig", *ODDS), "sig").select(
        "key", "sig", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), *ODDS
    )
    written = materialize(members, "jaccard-members")
    discard(placed)
    links, labels, sets = None, None, None
    fetched, linked = [], []
    for turn, share in enumerate(HUBS):
        if labels is not None:
            written = open_lists(written, labels)
        members = written if labels is not None else written.withColumn("label", F.col("sig"))
        other = [F.col(c).alias(d) for c, d in (("sig", "hub"), ("n", "n2"), ("pos", "pos2"), *((c, f"{c}_2") for c in ODDS), ("label", "label2"))]
        if share:
            pairs = across(members, other, share, num, den)
        else:
            # one hub for all lists of a group at first, then a hub of its own for each list
            order = F.xxhash64("sig") if turn == 0 else F.xxhash64("sig", "key")
            hub = members.groupBy("key").agg(F.min(F.struct(order.alias("h"), *other)).alias("hub"))
            pairs = members.join(hub.select("key", "hub.*").drop("h"), "key").where("label <> label2")
        pairs = pairs.where(_may_link(num, den)).select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
        pairs = materialize(plausible(pairs.distinct(), counted.select("sig", "blob"), num, den), "jaccard-pairs")
        needed = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        if sets is not None:
            needed = needed.join(sets.select("sig"), "sig", "left_anti")
        new = materialize(fetch_sets(docs, least.join(needed, "sig", "left_semi"), words), "jaccard-sets")
        fetched.append(new)
        sets = new if sets is None else sets.unionByName(new)
        found = materialize(verified(pairs, sets, num, den), "jaccard-links")
        discard(pairs)
        linked.append(found)
        if links is not None and found.limit(1).count() == 0:
            continue
        links = found if links is None else links.unionByName(found)
        before, labels = labels, connected_components(links, "jaccard")
        discard(before)
    discard(written, counted, *fetched, *linked)
    by_sig = sets_of.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    labelled = by_sig.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    labelled = materialize(labelled, "jaccard-labelled")
    joined = labelled.join(labels.select(F.col("label")).distinct(), "label", "left_semi").groupBy("label").agg(F.min("least").alias("component"))
    by_sig = materialize(labelled.join(joined, "label", "left").select("sig", F.coalesce("component", "least").alias("component")), "jaccard-components")
    discard(labelled, labels)
    return sets_of.join(by_sig, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the row of the least doc_id.

    Rows without a doc_id stay (they cannot be told apart from the group's other rows). Of
    rows that share the doc_id kept, the one of the least hash over all columns stays.
    Columns may have any names.
    """
    from pyspark.sql import Window

    spare = lambda name: name if name not in docs.columns else spare(name + "_")
    own, row = spare("least_id"), spare("row_of_id")
    found = components(docs.select("doc_id", "text"), **options)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    with_id = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(own), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    once = with_id.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    return once.unionByName(docs.where("doc_id is null"))
