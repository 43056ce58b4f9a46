"""Operators that repeat a join until nothing changes.

Each round is cut off by a reliable checkpoint in the session's shared folder, so that a lost
executor costs one round at most and plans stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, scratch_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder (see storage.scratch_dir)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every dst that src reaches; a path of length L takes about log2(L) rounds.

    A round joins the newest pairs with all known ones, in front and behind, and writes only
    what is new.
    """
    new = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "closure")
    known = new
    while not new.isEmpty():
        ahead = new.withColumnRenamed("dst", "via").join(known.withColumnRenamed("src", "via"), "via").select("src", "dst")
        behind = known.withColumnRenamed("dst", "via").join(new.withColumnRenamed("src", "via"), "via").select("src", "dst")
        new = materialize(ahead.unionByName(behind).distinct().join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.unionByName(new)
    return known


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) in topological order: 0 without incoming edges; nodes on or behind cycles are left out."""
    left = checkpointed(edges.select("src", "dst").distinct())
    nodes = checkpointed(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    out, level = None, 0
    while True:
        free = nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti")
        free = checkpointed(free.withColumn("level", F.lit(level)))
        if free.isEmpty():
            return free if out is None else out
        out = free if out is None else out.unionByName(free)
        left = checkpointed(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        nodes, level = checkpointed(nodes.join(free, "node", "left_anti")), level + 1


def greedy_fill(items: DataFrame, key: str, order: list[Column], cost: str, budget: float) -> DataFrame:
    """The items that a pass in the given order takes while they fit the key's budget; others are skipped.

    A round takes each key's longest prefix that fits, then drops what the rest of the budget
    cannot pay: the first item that did not fit is among these, and what is left never grows.
    """
    rest = checkpointed(items.where(F.col(cost) <= budget).withColumn("__left", F.lit(float(budget))))
    taken = None
    w = Window.partitionBy(key).orderBy(*order)
    while not rest.isEmpty():
        ran = rest.withColumn("__run", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        ran = checkpointed(ran.withColumn("__in", F.max((F.col("__run") > F.col("__left")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0))
        got = ran.where("__in").drop("__left", "__run", "__in")
        taken = got if taken is None else taken.unionByName(got)
        spent = ran.where("__in").groupBy(key).agg(F.max("__run").alias("__spent"))
        after = ran.where("not __in").join(spent, key).withColumn("__left", F.col("__left") - F.col("__spent"))
        rest = checkpointed(after.where(F.col(cost) <= F.col("__left")).drop("__run", "__in", "__spent"))
    return items.limit(0) if taken is None else taken
