"""Files of a folder tree by their metadata, and results that were written in more than one shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources of a project, installed packages, and tests.
EXCLUDED = ("node_modules", ".git", "cache", "out", "build", "artifacts", "typechain", "typechain-types", "coverage", ".deps", "crytic-export")
PACKAGES = ("node_modules", "lib")
TESTS = ("test", "tests", "test-foundry")


def discover(spark: SparkSession, root: str, suffix: str = ".sol", tests: bool = False, mocks: bool = False, packages: bool = False, max_kb: int = 500, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """(path, relative_path, size) of the files below ``root`` that end in ``suffix``, of 1 byte to ``max_kb`` KB.

    Files of excluded folders are left out, those of installed packages, tests and mocks too
    unless asked for. Only metadata is read; any store that Spark lists will do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path", F.col("length").alias("size"))
    tail = "/" + root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    inner = F.substring_index("path", tail, -1)
    rows = files.withColumn("relative_path", inner).withColumn("parts", F.split("relative_path", "/")).withColumn("folders", F.slice("parts", F.lit(1), F.size("parts") - 1))
    name, lowered = F.lower(F.element_at("parts", -1)), F.transform("parts", F.lower)
    in_any = lambda names: F.arrays_overlap("folders", F.array(*[F.lit(n) for n in names]))
    keep = (F.col("size") > 0) & (F.col("size") <= max_kb * 1024) & ~in_any(excluded)
    if not packages:
        keep &= ~in_any(PACKAGES)
    if not tests:
        keep &= ~(in_any(TESTS) | F.endswith(name, F.lit(f".t{suffix}")) | F.startswith(name, F.lit("test")) | F.startswith(name, F.lit("mock")) | F.array_contains(lowered, "test"))
    if not mocks:
        keep &= ~(name.rlike("mock|stub|fake") | F.array_contains(lowered, "mock"))
    return rows.where(keep).select("path", "relative_path", "size")


def latest_file(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path): the file of the latest change that fits ``glob``, the greatest path of equals; no row without one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).where("path is not null")


def model_signals(spark: SparkSession, root: str, name: str = "results.json") -> DataFrame:
    """(base, rmse, confidence) of the result files below ``root``: one object a file, in either of two shapes.

    A successful ``ensemble`` gives its result; else the first of the least rmse among
    ``results`` does. A missing rmse is infinite, a missing confidence 0, a missing base
    ``unknown``; of several files of a base the one of the greatest path counts. Files of
    neither shape, or that are no JSON, are left out.
    """
    fit = "struct<rmse: double, confidence: double>"
    schema = f"base string, ensemble struct<success: boolean, result: {fit}>, results array<struct<fit: {fit}>>"
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root).select("*", F.col("_metadata.file_path").alias("path"))
    far = lambda x: F.coalesce(x, F.lit(float("inf")))
    ranked = F.array_sort(F.transform("results", lambda r, i: F.struct(far(r["fit"]["rmse"]).alias("rmse"), i.alias("place"), r["fit"]["confidence"].alias("confidence"))))
    won = F.coalesce(F.col("ensemble.success"), F.lit(False))
    pick = F.when(won, F.struct(far(F.col("ensemble.result.rmse")).alias("rmse"), F.col("ensemble.result.confidence").alias("confidence"))).when(
        F.size("results") > 0, F.struct(ranked[0]["rmse"].alias("rmse"), ranked[0]["confidence"].alias("confidence"))
    )
    shown = found.select(F.coalesce("base", F.lit("unknown")).alias("base"), "path", pick.alias("pick")).where("pick is not null")
    return shown.groupBy("base").agg(F.max_by("pick", "path").alias("pick")).select("base", "pick.rmse", F.coalesce("pick.confidence", F.lit(0.0)).alias("confidence"))


def export(rows: DataFrame, path: str, columns: Sequence[str], form: str = "csv") -> None:
    """Write the named columns as CSV with a header or as JSON lines; columns that are missing are empty."""
    shown = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    writer = shown.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)
