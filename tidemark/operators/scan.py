"""Ordered scans: bounds, projections, filters, pending-write overlays and tombstone masks; key look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import functions as fn


def bounded(table: DataFrame, key: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = False) -> DataFrame:
    """Rows whose key lies between the bounds; None is no bound. Plain comparisons, which file scans push down."""
    if low is not None:
        table = table.where(F.col(key) >= low if low_inclusive else F.col(key) > low)
    if high is not None:
        table = table.where(F.col(key) <= high if high_inclusive else F.col(key) < high)
    return table


def scan(table: DataFrame, key: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = False, backward: bool = False, keys_only: bool = False, records_only: bool = False, ordered: bool = True) -> DataFrame:
    """A range scan in key order, forward or backward; keys or records only drop columns before any shuffle, and an
    unordered scan has no shuffle at all."""
    out = bounded(table, key, low, high, low_inclusive, high_inclusive)
    if keys_only:
        out = out.select(key)
    if ordered:
        out = out.orderBy(F.col(key).desc() if backward else F.col(key).asc())
    return out.drop(key) if records_only else out


def overlay(base: DataFrame, writes: DataFrame, key: str, low: Any = None, low_inclusive: bool = True, backward: bool = False) -> DataFrame:
    """A scan merged with a transaction's own writes (key, op, payload); base has `version`.

    A pending write wins over the scanned row and keeps its version; rows only written have version 1; pending
    deletions stay as tombstones without payload. A backward scan starts from its bound downwards."""
    side = (lambda x: bounded(x, key, high=low, high_inclusive=low_inclusive)) if backward else (lambda x: bounded(x, key, low=low, low_inclusive=low_inclusive))
    payload = [c for c in base.columns if c not in (key, "version")]
    own = side(writes).select(F.col(key).alias("_k"), F.col("op").alias("_op"), *[F.col(c).alias(f"_{c}") for c in payload])
    both = side(base).join(own, F.col(key) == F.col("_k"), "full_outer")
    gone = F.col("_op") == "D"
    values = [F.when(gone, None).when(F.col("_op").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in payload]
    out = both.select(F.coalesce(key, "_k").alias(key), F.coalesce("version", F.lit(1)).cast("long").alias("version"), F.when(gone, fn.DELETED).otherwise(fn.NORMAL).alias("status"), *values)
    return out.orderBy(F.col(key).desc() if backward else F.col(key).asc())


def mask(store: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Rows of the store but those that a tombstone among entries (key, op) hides."""
    return store.join(entries.where("op = 'D'").select(key).distinct(), key, "left_anti")


def filter_objects(table: DataFrame, key: str | None = None, pattern: str = "", kind: str | None = None, object_type: Any = None, ttl_ms: Column | None = None, now_ms: int = 0) -> DataFrame:
    """Object scan filters: type (None takes all), key pattern, and time to live."""
    if object_type is not None and kind is not None:
        table = table.where(F.col(kind) == object_type)
    if key is not None and pattern:
        table = table.where(fn.matches(F.col(key), pattern))
    return table if ttl_ms is None else table.where(fn.alive(ttl_ms, now_ms))


def drop_durable_tombstones(log: DataFrame, checkpoint_ts: int) -> DataFrame:
    """Without deletions that a checkpoint holds already."""
    return log.where(~((F.col("op") == "D") & (F.col("commit_ts") <= checkpoint_ts)))


def point_read(base: DataFrame, writes: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key with its record, version and status; a transaction's own pending write (key, op, payload) comes
    first and keeps the version that it was read at, 1 where there was none.

    base: a snapshot (key, version, payload). Keys that are nowhere are Deleted at version 0, without payload."""
    payload = [c for c in base.columns if c not in (key, "version")]
    asked = wanted.select(key).distinct()
    held = base.select(F.col(key).alias("_b"), "version", *[F.col(c).alias(f"_base_{c}") for c in payload])
    own = writes.select(F.col(key).alias("_w"), F.col("op").alias("_op"), *[F.col(c).alias(f"_own_{c}") for c in payload])
    got = asked.join(held, F.col(key) == F.col("_b"), "left").join(own, F.col(key) == F.col("_w"), "left")
    written = F.col("_op").isNotNull()
    values = [F.when(F.col("_op") == "D", None).when(written, F.col(f"_own_{c}")).otherwise(F.col(f"_base_{c}")).alias(c) for c in payload]
    status = F.when(F.when(written, F.col("_op") != "D").otherwise(F.col("_b").isNotNull()), fn.NORMAL).otherwise(fn.DELETED)
    version = F.coalesce("version", F.when(written, 1).otherwise(0)).cast("long")
    return got.select(key, version.alias("version"), status.alias("status"), *values)


def store_get(table: DataFrame, **key: Any) -> DataFrame:
    """The store's row of one key; equality with literals reaches the file scan."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
STORE_TYPES = {"Numeric": "double", "String": "string", "Bool": "boolean", "Blob": "binary"}


def store_scan(table: DataFrame, key: str, start: Any = None, inclusive: bool = True, conditions: Sequence[tuple[str, str, str, str]] = (), forward: bool = True) -> DataFrame:
    """A scan of the store from start on with conditions (field, operator, value, type), all of which must hold.

    Values are cast to their type as literals, so that comparisons reach the file scan."""
    out = bounded(table, key, low=start, low_inclusive=inclusive) if forward else bounded(table, key, high=start, high_inclusive=inclusive)
    for field, operator, value, kind in conditions:
        literal = {"Numeric": float, "String": str, "Bool": lambda v: v.lower() in ("1", "true"), "Blob": str.encode}[kind](value)
        out = out.where(getattr(F.col(field), OPERATORS[operator])(F.lit(literal)))
    return out.orderBy(F.col(key).asc() if forward else F.col(key).desc())


def multi_get(wanted: DataFrame, table: DataFrame, key: str, ordinal: str = "ord") -> DataFrame:
    """Each wanted key (with its ordinal) with its record and status; missing keys are Deleted with nulls.

    Spark's own size checks choose between a broadcast and a shuffle."""
    held = table.withColumn("_there", F.lit(True))
    got = wanted.join(held, key, "left")
    return got.withColumn("status", F.when(F.col("_there"), fn.NORMAL).otherwise(fn.DELETED)).drop("_there")


def ordering_faults(table: DataFrame, key: str, partition: str) -> DataFrame:
    """Per partition: entries and how many of them are out of order, by their place `pos`."""
    from pyspark.sql import Window

    before = F.lag(key).over(Window.partitionBy(partition).orderBy("pos"))
    return table.withColumn("_before", before).groupBy(partition).agg(F.count(F.lit(1)).alias("entries"), F.sum((F.col("_before") > F.col(key)).cast("long")).alias("faults")).na.fill(0, ["faults"])
