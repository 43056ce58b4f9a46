"""Written intermediate tables: where they go, and who removes them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}
_owner = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine gets a temporary folder of its own where none is set;
    on a cluster other machines could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Cuts the lineage: later jobs and retries after a lost executor start from the written
    files, which every executor can read. The shuffle files of the write go as it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessel/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    if before is not None:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _written[path] = spark
    if getattr(_owner, "paths", None) is not None:
        _owner.paths.append(path)
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame | None) -> None:
    """Remove the folders of materialized frames that nothing reads any more.

    Their shuffle files go too.
    """
    spark = None
    for frame in frames:
        path = getattr(frame, "written_path", None)
        if path in _written:
            spark = _written[path]
            _delete(path)
    if spark is not None:
        drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of plans that are done go.

    They go when the driver's JVM collects the plans that made them; a large heap may not be
    collected for hours, so it is asked to be.
    """
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def owned(paths: list[str]) -> Iterator[list[str]]:
    """Notes in ``paths`` every folder that this thread writes inside."""
    before = getattr(_owner, "paths", None)
    _owner.paths = paths
    try:
        yield paths
    finally:
        _owner.paths = before


def release(paths: list[str]) -> None:
    """Remove the folders noted in ``paths`` that are still there."""
    while paths:
        _delete(paths.pop())


def left() -> list[str]:
    """The folders written and not yet removed."""
    return list(_written)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release(list(_written))
