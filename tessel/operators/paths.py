"""Paths as arrays that grow by one join a round: maximal paths, cycles, beams.

Each round's frontier is written to the session's shared folder, so that a plan holds one
round and a lost executor costs one. Edges are rows of (kind, src, dst); a path stays within
its kind. Null ends are no edges, and repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


FEW_PATHS = 20_000  # paths that may go to every task
TRIM = 20  # a round of trimming that takes away a smaller part of the edges is the last


def _clean(edges: DataFrame) -> DataFrame:
    return materialize(edges.select("kind", "src", "dst").where("src is not null and dst is not null").distinct(), "edges")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def starts(edges: DataFrame) -> DataFrame:
    """(kind, node): nodes of a kind without incoming edges; all that have outgoing ones where a kind has none such."""
    sources = edges.select("kind", F.col("src").alias("node")).distinct()
    free = sources.join(edges.select("kind", F.col("dst").alias("node")), ["kind", "node"], "left_anti")
    return free.unionByName(sources.join(free.select("kind").distinct(), "kind", "left_anti"))


def maximal_paths(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(kind, path): simple paths of two nodes or more from each start that no edge carries on.

    One outer join a round tells the paths that grow from those that have ended; FEW_PATHS at
    most are sent to the edges instead, so that late rounds shuffle no edges. Ends when no
    path grows; with ``longest``, paths of so many nodes end there.
    """
    edge = _clean(edges)
    front = materialize(starts(edge).select("kind", F.array("node").alias("path")), "paths")
    ended = []
    nodes, n = 1, front.count()
    while n and (longest is None or nodes < longest):
        here = front.withColumn("src", F.element_at("path", -1)).alias("p")
        may = (F.col("p.kind") == F.col("e.kind")) & (F.col("p.src") == F.col("e.src")) & ~F.array_contains("p.path", F.col("e.dst"))
        if n > FEW_PATHS:
            step = materialize(here.join(edge.alias("e"), may, "left").select("p.kind", "p.path", F.col("e.dst").alias("dst")), "paths")
            over, grown = step.where("dst is null").select("kind", "path"), step.where("dst is not null")
        else:  # an outer join would shuffle all edges for the sake of few paths
            grown = materialize(edge.alias("e").join(F.broadcast(here), may).select("p.kind", "p.path", F.col("e.dst").alias("dst")), "paths")
            over = front.join(grown.select("kind", "path"), ["kind", "path"], "left_anti")
        if nodes > 1:
            ended.append(over)
        front = grown.select("kind", F.array_append("path", F.col("dst")).alias("path"))
        nodes, n = nodes + 1, grown.count()
    return _union([*ended, front])


def cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """(kind, cycle): simple cycles of 3 to ``longest`` nodes within a kind, each once, from its least node.

    Edges whose ends can lie on no cycle of that kind go first, as long as a round of
    trimming takes one in TRIM away; a path grows over nodes above its first one only. The
    join that grows a path also tells whether an edge leads back to its first node.
    """
    edge = _clean(edges.where("src <> dst"))
    left = edge.count()
    while left:
        keep = edge.join(edge.select("kind", F.col("dst").alias("src")).distinct(), ["kind", "src"], "left_semi")
        edge = materialize(keep.join(edge.select("kind", F.col("src").alias("dst")).distinct(), ["kind", "dst"], "left_semi").select("kind", "src", "dst"), "edges")
        before, left = left, edge.count()
        if (before - left) * TRIM < before:
            break
    front = edge.where("dst > src").select("kind", F.array("src", "dst").alias("path"))
    found = []
    for nodes in range(2, longest + 1):
        here = front.withColumn("src", F.element_at("path", -1))
        back = F.col("dst") == F.col("path")[0]
        grows = (F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))
        wanted = back if nodes == longest else grows if nodes == 2 else back | grows
        step = materialize(here.join(edge, ["kind", "src"]).where(wanted).select("kind", "path", "dst"), "paths")
        if nodes > 2:
            found.append(step.where(back).select("kind", F.col("path").alias("cycle")))
        front = step.where(~back).select("kind", F.array_append("path", F.col("dst")).alias("path"))
        if step.isEmpty():
            break
    return _union(found) if found else front.withColumnRenamed("path", "cycle").limit(0)


def beam(seeds: DataFrame, edges: DataFrame, gains: DataFrame, width: int, depth: int) -> DataFrame:
    """(beam, step, place, path, score): the ``width`` best paths of each beam after every step.

    ``seeds`` is (beam, node), ``edges`` (src, dst), ``gains`` (node, gain); a path scores the
    sum of its nodes' gains (none: 0) rounded to six places and visits no node twice. A step
    grows what the step before has kept; of equal scores the least path comes first. Tasks
    keep their own best before any shuffle, so a beam of many seeds or wide hubs is pruned early.
    """
    gain = gains.groupBy("node").agg(F.max("gain").alias("gain"))
    edge = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    edge = materialize(edge.join(gain.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", F.coalesce("gain", F.lit(0.0)).alias("gain")), "edges")
    order = Window.partitionBy("beam").orderBy(F.desc("score"), "path")

    def best(paths: DataFrame, step: int) -> DataFrame:
        placed = paths.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)
        return materialize(placed.select("beam", F.lit(step).alias("step"), "place", "path", "score"), "beam")

    begun = seeds.select("beam", "node").where("node is not null").distinct().join(gain, "node", "left")
    front = best(begun.select("beam", F.array("node").alias("path"), F.round(F.coalesce("gain", F.lit(0.0)), 6).alias("score")), 0)
    kept = [front]
    for step in range(1, depth + 1):
        grown = front.withColumn("src", F.element_at("path", -1)).join(edge, "src").where(~F.array_contains("path", F.col("dst")))
        front = best(grown.select("beam", F.array_append("path", F.col("dst")).alias("path"), F.round(F.col("score") + F.col("gain"), 6).alias("score")), step)
        if front.isEmpty():
            break
        kept.append(front)
    return _union(kept)
