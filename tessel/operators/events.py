"""Event log: filtered scans, latest rows, retention and upserts.

Events have (event_id, ts, user_id, event_type, props). Times are compared as given, so
filters on them reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query(events: DataFrame, kind: str | None = None, user: int | None = None, text: str | None = None, since=None, until=None, match: str = "or") -> DataFrame:
    """Rows by type OR (or AND) user, then inclusive time bounds and a substring of type + payload."""
    asked = [F.col(c) == v for c, v in (("event_type", kind), ("user_id", user)) if v is not None]
    if asked:
        both = asked[0] if len(asked) == 1 else (asked[0] & asked[1] if match == "and" else asked[0] | asked[1])
        events = events.where(both)
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    if text is not None:
        events = events.where(F.contains(F.concat_ws(" ", "event_type", "props"), F.lit(text)))
    return events


def latest(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def latest_one(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key by ``by``: an aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__r"))
    return best.select(*keys, "__r.*")


def unexpired(events: DataFrame, now: Column, ttl_s: Column, pinned: Column) -> DataFrame:
    """Rows that are pinned, have no TTL, or are not older than it."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return events.where(pinned | ttl_s.isNull() | (age <= ttl_s))


def selective_forget(events: DataFrame, now: Column, age_days: int, pinned: Column, max_removals: int) -> DataFrame:
    """Without the oldest rows of at least that age that are not pinned, ``max_removals`` at most."""
    old = events.where(~pinned & (F.col("ts") <= now - F.expr(f"interval {age_days} days")))
    gone = old.orderBy("ts", "event_id").limit(max_removals).select("event_id")
    return events.join(gone, "event_id", "left_anti")


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the latest of its changes by ``order``, else the latest stored one.

    A null key is equal to none: rows of such keys all stay, stored ones and changes.
    """
    blank = F.col(key).isNull()
    unkeyed = stored.where(blank).unionByName(changes.where(blank).select(*stored.columns))
    stored, changes = stored.where(~blank), changes.where(~blank)
    both = stored.select(F.lit(0).alias("p"), F.struct(*stored.columns).alias("r")).unionByName(changes.select(F.lit(1).alias("p"), F.struct(*stored.columns).alias("r")))
    latest = both.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", F.struct("p", F.col(f"r.{order}"))).alias("r"))
    return latest.select("r.*").unionByName(unkeyed)
