"""Streams of files: running counts, windows, keyed states; a restart goes on from its checkpoint."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessel.streaming import stateful

SCHEMA = "key string, id long, ts_us long, name string, value double"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def rows_of(rng, n, first):
    return [(rng.choice(["a", "b", None]), first + k, rng.randrange(1000) + 1000 * first, rng.choice(["x", "y", "z", "w", None]), rng.choice([None, 1.0, 2.5, float(k)])) for k in range(n)]


def run(spark, tmp_path, transform, batches, mode="update"):
    """Results of each batch; every batch is a query of its own that goes on from the same checkpoint."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        name = f"out_{tmp_path.name.replace('-', '_')}_{k}"
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        got = []
        q = transform(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _, got=got: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out.append({r[0]: r for r in got})
    return out


def ordered(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))


def test_recent_items(spark, rocksdb, tmp_path):
    rng = random.Random(1)
    batches = [rows_of(rng, 60, 0), rows_of(rng, 5, 100), rows_of(rng, 40, 200)]
    batches = [[(*r[:4], r[4] or 0.0) for r in b] for b in batches]
    seen = []
    for batch, got in zip(batches, run(spark, tmp_path, lambda s: stateful.recent_items(s, 20), batches), strict=True):
        seen += batch
        assert set(got) == {r[0] for r in batch} - {None}
        for key, row in got.items():
            last = ordered(seen, key)[-20:]
            assert row.ids == [r[1] for r in last] and row.n == len(last)
            assert row.mean_value == pytest.approx(sum(r[4] for r in last) / len(last))


def test_running_profile(spark, rocksdb, tmp_path):
    rng = random.Random(2)
    batches = [rows_of(rng, 30, 0), rows_of(rng, 30, 100)]
    seen = []
    for batch, got in zip(batches, run(spark, tmp_path, stateful.running_profile, batches), strict=True):
        seen += [r for r in ordered(batch, "a") + ordered(batch, "b") if r[4] is not None]
        for key, row in got.items():
            values = [r[4] for r in seen if r[0] == key]
            ema = values[0]
            for v in values[1:]:
                ema = 0.3 * v + 0.7 * ema
            assert (row.n, row.last) == (len(values), values[-1])
            assert row.mean == pytest.approx(sum(values) / len(values)) and row.ema == pytest.approx(ema)


def test_lru_cache(spark, rocksdb, tmp_path):
    rng = random.Random(3)
    batches = [rows_of(rng, 25, 0), rows_of(rng, 25, 100), rows_of(rng, 25, 200)]
    held = {"a": [], "b": []}
    for batch, got in zip(batches, run(spark, tmp_path, lambda s: stateful.lru_cache(s, 2), batches), strict=True):
        for key, names in held.items():
            hits = 0
            for _, _, _, name, value in ordered(batch, key):
                if name is None:
                    continue
                hits += value is None and name in names
                if name in names or value is not None:
                    names[:] = [x for x in names if x != name] + [name]
                    del names[:-2]
            assert got[key].names == names and got[key].hits == hits


def test_idle_keys_are_forgotten(spark, rocksdb, tmp_path):
    spark.createDataFrame([("a", 1, 1, "x", 1.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.recent_items(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 5, idle_ms=500)
    got = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            if len(got) > 1 or q.exception():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.key, r.n, list(r.ids)) for r in got] == [("a", 1, [1]), ("a", 0, [])]


def test_built_in_states(spark, tmp_path):
    rows = [("a", k, 0, "x", float(k % 3)) for k in range(9)]
    got = run(spark, tmp_path / "counts", lambda s: stateful.perception(s.withColumn("event_type", F.lit("error"))), [rows, rows], "complete")
    assert got[1]["error"].n == 18 and got[1]["error"].errors == 18
    timed = lambda s: s.select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 86400).alias("ts"), F.col("name").alias("event_type"), "value")
    once = run(spark, tmp_path / "once", lambda s: stateful.once_each(timed(s), "1 hour"), [rows, rows], "append")
    assert len(once[0]) == 9 and not once[1]
    by_window = run(spark, tmp_path / "windows", lambda s: stateful.windowed(timed(s), "3 minutes", "1 hour"), [rows], "update")
    assert [r.n for r in by_window[0].values()] == [3, 3, 3]
