"""What functions read and write: conflicts, dependencies, chains, overrides and inherited protections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterative import closure


def _side(effects: DataFrame, kind: str, name: str) -> DataFrame:
    return effects.where((F.col("kind") == kind) & F.col("var").isNotNull()).select("contract", "var", F.col("function").alias(name)).distinct()


def _names(c: str) -> Column:
    return F.array_sort(F.collect_set(c))


def dependencies(effects: DataFrame) -> DataFrame:
    """(contract, function, conflicts_with, depends_on) of (contract, function, var, kind): others that write what it writes, and what it reads.

    Both are sorted lists of functions of the same contract; a function of neither has empty
    ones. A pair is counted once before lists are made, however many variables it shares.
    """
    writers = _side(effects, "write", "other")
    every = effects.select("contract", "function").distinct()

    def others(kind: str, name: str) -> DataFrame:
        pairs = _side(effects, kind, "function").join(writers, ["contract", "var"]).where("function <> other").select("contract", "function", "other").distinct()
        return pairs.groupBy("contract", "function").agg(_names("other").alias(name))

    empty = F.array().cast("array<string>")
    both = every.join(others("write", "conflicts_with"), ["contract", "function"], "left").join(others("read", "depends_on"), ["contract", "function"], "left")
    return both.select("contract", "function", *[F.coalesce(F.col(c).cast("array<string>"), empty).alias(c) for c in ("conflicts_with", "depends_on")])


def cross_function_edges(effects: DataFrame, functions: DataFrame) -> DataFrame:
    """(contract, writer, reader, var): an unguarded function that calls out writes what another, public one reads.

    ``functions`` is (contract, function, public, calls_out, guarded); null flags are false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_ = functions.where(flag("calls_out") & ~flag("guarded")).select("contract", F.col("function").alias("writer")).distinct()
    shown = functions.where(flag("public")).select("contract", F.col("function").alias("reader")).distinct()
    writes = _side(effects, "write", "writer").join(open_, ["contract", "writer"], "left_semi")
    reads = _side(effects, "read", "reader").join(shown, ["contract", "reader"], "left_semi")
    return writes.join(reads, ["contract", "var"]).where("writer <> reader").select("contract", "writer", "reader", "var")


def profit_chains(effects: DataFrame, functions: DataFrame, weight: float = 2.5) -> DataFrame:
    """(contract, source, target, shared, weight): one that manipulates state writes what a profitable one reads.

    ``functions`` is (contract, function, manipulates, profitable); ``shared`` lists the variables.
    """
    marked = lambda c, name: functions.where(F.coalesce(F.col(c), F.lit(False))).select("contract", F.col("function").alias(name)).distinct()
    writes = _side(effects, "write", "source").join(marked("manipulates", "source"), ["contract", "source"], "left_semi")
    reads = _side(effects, "read", "target").join(marked("profitable", "target"), ["contract", "target"], "left_semi")
    pairs = writes.join(reads, ["contract", "var"]).where("source <> target").groupBy("contract", "source", "target")
    return pairs.agg(_names("var").cast("array<string>").alias("shared")).withColumn("weight", F.lit(weight))


def resolved_members(chain: DataFrame, members: DataFrame, parts: int | None = None) -> DataFrame:
    """(contract, member, owner, overridden) of (contract, ancestor, place) and (ancestor, member): the first in the chain that defines a member.

    ``overridden`` counts the further definitions behind it; of equal places the least ancestor comes first.
    ``parts`` is how many tasks share the found definitions (None: as the session has it).
    """
    found = (chain.repartition(parts, "ancestor") if parts else chain).join(members.distinct(), "ancestor")
    if parts:
        found = found.repartition(parts, "contract", "member")
    found = found.groupBy("contract", "member")
    return found.agg(F.min_by("ancestor", F.struct("place", "ancestor")).alias("owner"), (F.count("*") - 1).alias("overridden"))


def inherited(parents: DataFrame, protections: DataFrame) -> DataFrame:
    """(contract, protections): sorted names of (contract, name) that a contract has itself or from any ancestor of (src, dst)."""
    above = closure(parents).select(F.col("src").alias("contract"), F.col("dst").alias("owner"))
    own = protections.select("contract", F.col("contract").alias("owner"))
    both = above.unionByName(own).distinct().join(protections.withColumnRenamed("contract", "owner"), "owner")
    return both.groupBy("contract").agg(_names("name").alias("protections"))


def blend_fits(fits: DataFrame, keys: list[str], close: float = 0.05) -> DataFrame:
    """(keys, winner, a, b, rmse, confidence, blended) of (keys, family, a, b, rmse, confidence): the best fit, blended with the next of its family.

    Fits are ordered by rmse, then falling confidence; the next of the same family within
    ``close`` of its rmse is blended in by confidence. A key's fits are few: one a candidate.
    """
    order = F.struct("rmse", (-F.col("confidence")).alias("c"), "family", "a", "b")
    listed = fits.dropna(subset=["rmse", "confidence"]).groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("fits"))
    top = F.col("fits")[0]
    other = F.get(F.filter(F.slice("fits", F.lit(2), F.size("fits")), lambda f: f["family"] == top["family"]), F.lit(0))
    near = other.isNotNull() & (((top["rmse"] == 0) & (other["rmse"] == 0)) | (F.abs(top["rmse"] - other["rmse"]) / F.greatest(F.abs(top["rmse"]), F.lit(1e-12)) <= close))
    shown = listed.select(*keys, top.alias("t"), other.alias("o"), F.coalesce(near, F.lit(False)).alias("blended"))
    wa, wb = F.greatest(-F.col("t.c"), F.lit(1e-9)), F.greatest(-F.col("o.c"), F.lit(1e-9))
    mixed = lambda c: F.when(F.col("blended"), (F.col(f"t.{c}") * wa + F.col(f"o.{c}") * wb) / (wa + wb)).otherwise(F.col(f"t.{c}")).alias(c)
    confidence = F.when(F.col("blended"), F.greatest(-F.col("t.c"), -F.col("o.c"))).otherwise(-F.col("t.c"))
    return shown.select(*keys, F.concat("t.family", F.when(F.col("blended"), " (blended)").otherwise("")).alias("winner"), mixed("a"), mixed("b"), mixed("rmse"), confidence.alias("confidence"), "blended")
