"""Readers and writers with explicit schemas; bad records are dropped or kept, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """JSON lines; bad lines go, or stay whole in ``_corrupt_record``."""
    if not keep_bad:
        return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).json(path, mode="PERMISSIVE")


def read_numbers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header; rows with a cell that is no number are dropped."""
    text = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)
    return text.select(*[F.col(c).try_cast("double").alias(c) for c in columns]).dropna()


def append_jsonl(rows: DataFrame, path: str, min_score: float | None = None) -> None:
    """Append as JSON lines, rows of at least ``min_score`` only (a null score is rejected)."""
    kept = rows if min_score is None else rows.where(F.col("score") >= min_score)
    kept.write.mode("append").json(path)


def write_by(rows: DataFrame, path: str, column: str) -> None:
    """One folder for each value of ``column``."""
    rows.write.mode("overwrite").partitionBy(column).parquet(path)
