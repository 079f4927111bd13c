"""Multi-version operators: visible versions, archives, garbage collection and checkpoints.

A change log holds one row per committed version of a key. Aggregates by key (max_by and the like) combine within
tasks before their shuffle, so a key with a large share of the rows doesn't land in one task; windows by key are kept to
what aggregates can't tell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import functions as fn

Keys = Sequence[str]


def _payload(log: DataFrame, keys: Keys) -> list[str]:
    return [c for c in log.columns if c not in keys and c not in ("commit_ts", "op")]


def newest(log: DataFrame, keys: Keys, tie: str | None = None) -> DataFrame:
    """Last writer wins: the newest version of each key; equal timestamps go to the larger tie, else the larger payload."""
    rest = [c for c in log.columns if c not in keys]
    order = F.struct("commit_ts", tie) if tie else F.struct("commit_ts", *[c for c in rest if c != "commit_ts"])
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def as_of(log: DataFrame, keys: Keys, ts: int, tombstones: bool = False, tie: str | None = None) -> DataFrame:
    """The version of each key that is visible at ts; deleted ones are left out, or kept with null payload."""
    seen = newest(log.where(F.col("commit_ts") <= ts), keys, tie)
    if not tombstones:
        return seen.where("op <> 'D'").drop("op")
    gone = F.col("op") == "D"
    out = seen.withColumns({c: F.when(~gone, F.col(c)) for c in _payload(log, keys)})
    return out.withColumn("status", F.when(gone, fn.DELETED).otherwise(fn.NORMAL)).drop("op")


def visible_status(log: DataFrame, keys: Keys, ts: int, checkpoint_ts: int | Column) -> DataFrame:
    """keys, status, commit_ts: Normal or Deleted with the visible version's timestamp; else 1 and where to look for it."""
    visible = F.when(F.col("commit_ts") <= ts, F.struct("commit_ts", "op"))
    got = log.groupBy(*keys).agg(F.max(visible).alias("_v"))
    at = F.lit(checkpoint_ts).cast("long") if isinstance(checkpoint_ts, int) else checkpoint_ts
    status = F.when(F.col("_v.op") == "D", fn.DELETED).when(F.col("_v").isNotNull(), fn.NORMAL).otherwise(fn.miss_status(at, F.lit(ts)))
    return got.select(*keys, status.alias("status"), F.coalesce("_v.commit_ts", F.lit(fn.NOT_THERE)).cast("long").alias("commit_ts"))


def has_visible(log: DataFrame, keys: Keys, ts: int) -> DataFrame:
    return log.groupBy(*keys).agg((F.min("commit_ts") <= ts).alias("has_visible"))


def archive_counts(log: DataFrame, keys: Keys) -> DataFrame:
    """Archived versions of each key: all but the current one."""
    return log.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("archives"))


def add_archives(log: DataFrame, more: DataFrame, keys: Keys) -> DataFrame:
    """Union of versions by key and timestamp; those in log win, and deletions at timestamp 1 are never archived.

    A set union for any order of input."""
    more = more.where(~((F.col("commit_ts") == fn.NOT_THERE) & (F.col("op") == "D")))
    ranked = log.withColumn("_rank", F.lit(0)).unionByName(more.withColumn("_rank", F.lit(1)))
    rest = [c for c in ranked.columns if c not in (*keys, "commit_ts")]
    best = ranked.groupBy(*keys, "commit_ts").agg(F.min(F.struct("_rank", *[c for c in rest if c != "_rank"])).alias("_r"))
    return best.select(*keys, "commit_ts", "_r.*").drop("_rank").select(*log.columns)


def collect_garbage(log: DataFrame, keys: Keys, oldest_active: int) -> DataFrame:
    """Versions that some reader from oldest_active on can see: the newer ones, and the newest that isn't newer.

    The edge is one aggregate per key (combined within tasks) joined back, so no key's versions are gathered."""
    edge = log.where(F.col("commit_ts") <= oldest_active).groupBy(*keys).agg(F.max("commit_ts").alias("_edge"))
    both = log.join(edge, list(keys), "left")
    return both.where((F.col("commit_ts") > oldest_active) | (F.col("commit_ts") == F.col("_edge"))).drop("_edge")


def archives_since(log: DataFrame, from_ts: int) -> DataFrame:
    return log.where(F.col("commit_ts") >= from_ts)


def dirty(log: DataFrame, checkpoint_ts: int) -> DataFrame:
    """Versions that no checkpoint holds yet."""
    return log.where(F.col("commit_ts") > checkpoint_ts)


def checkpoint(log: DataFrame, keys: Keys, to_ts: int, checkpoint_ts: int = 0) -> DataFrame:
    """Rows that a checkpoint up to to_ts writes, with `target` base or archive.

    The newest version up to to_ts goes to the base if it is newer than the last checkpoint; with it, versions
    from the last checkpoint on go to the archive, but none at timestamp 1."""
    seen = log.where(F.col("commit_ts") <= to_ts)
    base = seen.groupBy(*keys).agg(F.max("commit_ts").alias("_base")).where(F.col("_base") > checkpoint_ts)
    both = seen.where(F.col("commit_ts") >= checkpoint_ts).join(base, list(keys))
    is_base = F.col("commit_ts") == F.col("_base")
    return both.where(is_base | (F.col("commit_ts") != fn.NOT_THERE)).withColumn("target", F.when(is_base, "base").otherwise("archive")).drop("_base")


def checkpoint_ts(min_active: int, base: int, delay: int) -> int:
    """Timestamp of the next checkpoint: the oldest reader's, between base - delay and base."""
    return max(base - delay, min(min_active, base))


def min_active(transactions: DataFrame, group: str, start: str) -> DataFrame:
    """Oldest start per node group and over all of them (group null)."""
    return transactions.rollup(group).agg(F.min(start).alias("min_start_ts"))


def snapshot_conflicts(log: DataFrame, writes: DataFrame, keys: Keys, read_ts: int) -> DataFrame:
    """Keys of writes whose newest version is younger than the writer's snapshot (first committer wins)."""
    latest = log.groupBy(*keys).agg(F.max("commit_ts").alias("commit_ts"))
    return writes.select(*keys).distinct().join(latest, list(keys)).where(F.col("commit_ts") > read_ts)


def as_of_join(probes: DataFrame, log: DataFrame, keys: Keys, ts: str, span: int) -> DataFrame:
    """probes (keys, ts, further columns) with the version visible at each row's own ts: seen_ts, seen_op and payload.

    Time is cut into spans. A version is carried into later spans of its key by a window over one row per key and
    span; within a span, probes look back over the span's versions. So no task needs all rows of a key. Rows
    without a visible version have nulls."""
    payload = _payload(log, keys)
    others = [c for c in probes.columns if c not in keys and c != ts]
    version = F.struct("commit_ts", "op", *payload)
    versions = log.select(*keys, F.col("commit_ts").alias("_t"), F.floor(F.col("commit_ts") / span).alias("_span"), version.alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(probes.select(F.struct(ts, *others)).schema[0].dataType).alias("_p"))
    asks = probes.select(*keys, F.col(ts).alias("_t"), F.floor(F.col(ts) / span).alias("_span"), F.lit(None).cast(versions.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_kind"), F.struct(ts, *others).alias("_p"))
    both = versions.unionByName(asks)
    per_span = both.groupBy(*keys, "_span").agg(F.max("_v").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_span.select(*keys, "_span", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    within = Window.partitionBy(*keys, "_span").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(within)).where("_kind = 1").join(carried, [*keys, "_span"], "left")
    got = F.coalesce("_seen", "_carry")
    return seen.select(*keys, "_p.*", got["commit_ts"].alias("seen_ts"), got["op"].alias("seen_op"), *[got[c].alias(c) for c in payload])
