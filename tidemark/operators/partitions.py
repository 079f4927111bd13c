"""Partitioning: buckets on a ring, ranges, slices, split plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import ranking

#: Bytes of a slice and of a range, the share of a range that a new one gets, virtual nodes of a group.
SLICE_BYTES, RANGE_BYTES, LOAD, VIRTUAL_NODES = 16 * 1024, 256 * 1024 * 1024, 0.1, 64


def with_bucket(table: DataFrame, key: str, buckets: int = fn.BUCKETS) -> DataFrame:
    return table.withColumn("bucket", fn.bucket(F.col(key), buckets))


def ring(groups: int, virtual: int = VIRTUAL_NODES, buckets: int = fn.BUCKETS) -> list[tuple[int, int]]:
    """(position, group) of each group's virtual nodes, by a multiplicative rule; the first group keeps a place that two want."""
    taken: dict[int, int] = {}
    for g in range(groups):
        x = g * 2654435761 + 97
        for _ in range(virtual):
            x = (x * 1103515245 + 12345) % (1 << 31)
            taken.setdefault((x >> 8) % buckets, g)
    return sorted(taken.items())


def ring_owner(buckets: DataFrame, nodes: DataFrame, bucket: str = "bucket") -> DataFrame:
    """buckets with `owner`, the group of the first virtual node (position, node_group) strictly behind, or else of the first.

    The ring is a few nodes per group and travels as one sorted array."""
    packed = nodes.groupBy().agg(F.array_sort(F.collect_list(F.struct("position", "node_group"))).alias("_ring"))
    behind = F.get(F.filter("_ring", lambda x: x["position"] > F.col(bucket)), 0)
    return buckets.join(F.broadcast(packed)).withColumn("owner", F.coalesce(behind, F.get("_ring", 0))["node_group"]).drop("_ring")


#: Ranges up to this number travel to the keys as one sorted array (a few MB); beyond it, both sides are cut into parts.
BROADCAST_RANGES = 65_536


def floor_lookup(keys: DataFrame, ranges: DataFrame, key: str, start: str, most: int = BROADCAST_RANGES) -> DataFrame:
    """Each key's row with that of the range that holds it: the one with the greatest start that isn't above it.

    Up to `most` ranges are broadcast and searched by halving, which is checked before. More are merged with the keys
    in order, in parts that each know the last range before them. Keys below all starts have nulls."""
    others = [c for c in ranges.columns if c != start]
    if ranges.limit(most + 1).count() > most:
        return _floor_merge(keys, ranges, key, start, others)
    packed = ranges.groupBy().agg(F.array_sort(F.collect_list(F.struct(start, *others))).alias("_r")).withColumn("_s", F.transform("_r", lambda x: x[start]))
    at = ranking.count_up_to(F.col("_s"), F.col(key), most) - 1
    found = keys.join(F.broadcast(packed)).withColumn("_at", at).withColumn("_x", F.when(F.col("_at") >= 0, F.get("_r", F.col("_at"))))
    return found.select(*keys.columns, *[F.col("_x")[c].alias(c) for c in (start, *others)])


def _floor_merge(keys: DataFrame, ranges: DataFrame, key: str, start: str, others: Sequence[str]) -> DataFrame:
    cuts = ranking.cut_points(ranges, start, 1024, 16_384)
    own = ranking.with_part(ranges.select(F.struct(start, *others).alias("_x"), F.col(start).alias("_k")), "_k", cuts)
    asked = ranking.with_part(keys.select(F.struct(*keys.columns).alias("_row"), F.col(key).alias("_k")), "_k", cuts)
    # The last range of the parts in front of each part; a row per part.
    last = own.groupBy("_part").agg(F.max_by("_x", "_k").alias("_x"), F.max("_k").alias("_k"))
    pairs = F.broadcast(last.withColumnRenamed("_part", "_p"))
    parts = keys.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_q"))
    carried = parts.join(pairs, F.col("_p") < F.col("_q")).groupBy("_q").agg(F.max_by("_x", "_k").alias("_carried"))
    both = asked.select("_part", "_k", "_row", F.lit(None).cast(own.schema["_x"].dataType).alias("_x")).unionByName(own.select("_part", "_k", F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_x"))
    order = Window.partitionBy("_part").orderBy("_k", F.col("_x").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_x", ignorenulls=True).over(order)).where("_row IS NOT NULL")
    found = found.join(F.broadcast(carried), F.col("_part") == F.col("_q"), "left").withColumn("_f", F.when(F.col("_k").isNotNull(), F.coalesce("_f", "_carried")))
    return found.select("_row.*", *[F.col("_f")[c].alias(c) for c in (start, *others)])


def sub_range_keys(table: DataFrame, key: str, target: int) -> DataFrame:
    """(pick, key): keys that cut a sample into target + 1 parts, every step from the first step on."""
    ranked = table.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("s"))
    step = F.greatest(F.lit(1), F.floor(F.col("s") / (target + 1)))
    pick = F.col("i") / step
    return ranked.where((F.col("i") % step == 0) & pick.between(1, target)).select(pick.cast("int").alias("pick"), key)


def slice_delta(changes: DataFrame, slice_: Column, old_size: Column, new_size: Column) -> DataFrame:
    """Change of each slice's size by its changed records."""
    return changes.groupBy(slice_.alias("slice")).agg(F.sum(new_size - old_size).cast("long").alias("delta"))


def cut_by_size(slices: DataFrame, order: str, size: str, parts: int) -> DataFrame:
    """slices with `part` (from 0) of about equal sizes: a slice's part is told by the sizes in front of it."""
    out = ranking.running(slices, order, _b=size)
    return out.withColumn("part", F.least(F.floor(F.col("_b") * parts / F.col("_b_all")), F.lit(parts - 1)).cast("int")).drop("_b", "_b_all")


def split_plan(slices: DataFrame, order: str, size: str, range_bytes: int = RANGE_BYTES, within: str | None = None) -> DataFrame:
    """(part, start, bytes, slices) of the ranges that a range becomes when it outgrows range_bytes, else one part.

    within: the column of the range's id, where slices of many ranges are planned at once; it is returned too. A range
    holds some ten thousand slices, so its window is small; without it, slices are added up in parts."""
    if within is None:
        planned, key = ranking.running(slices, order, _b=size), ["part"]
    else:
        w = Window.partitionBy(within)
        before = F.coalesce(F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        planned, key = slices.withColumns({"_b": before, "_b_all": F.sum(size).over(w)}), [within, "part"]
    parts = F.when(F.col("_b_all") > range_bytes, F.ceil(F.col("_b_all") / (range_bytes * LOAD))).otherwise(1)
    planned = planned.withColumn("part", F.least(F.floor(F.col("_b") * parts / F.col("_b_all")), parts - 1).cast("int"))
    return planned.groupBy(*key).agg(F.min(order).alias("start"), F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("slices"))


def range_metadata(records: DataFrame, key: str, range_: str, slice_: str, size: str) -> DataFrame:
    """(range_, start, last, slices, records, bytes): what is known of each range without reading its rows again."""
    per_slice = records.groupBy(range_, slice_).agg(F.min(key).alias("start"), F.max(key).alias("last"), F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"))
    return per_slice.groupBy(range_).agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.count(F.lit(1)).alias("slices"), F.sum("records").alias("records"), F.sum("bytes").cast("long").alias("bytes"),
    )


def rewrite_ranges(table: DataFrame, key: str, plan: DataFrame, start: str = "start", range_: str = "part") -> DataFrame:
    """table with `range_`, the new range of each row by its plan, dealt by ranges of the key and sorted, as files of ranges are.

    Rows in front of the first start belong to the first range."""
    first = plan.agg(F.min_by(range_, start).alias("_first"))
    found = floor_lookup(table, plan.select(F.col(start).alias("_start"), range_), key, "_start").join(F.broadcast(first))
    found = found.withColumn(range_, F.coalesce(range_, "_first")).drop("_first", "_start")
    return found.repartitionByRange(range_, key).sortWithinPartitions(range_, key)


#: A range's bucket is the 32-bit murmur hash of its id from this seed. Spark's hash chains from 42, under
#: which SEED_FIRST has the hash 9001.
RANGE_SEED, SEED_FIRST = 9001, -1836284516


def range_bucket(range_id: Column, buckets: int = fn.BUCKETS) -> Column:
    """Bucket of a range by its id (an int)."""
    hashed = F.hash(F.lit(SEED_FIRST), range_id.cast("int")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(hashed, F.lit(buckets))


def migration(buckets: DataFrame, before: DataFrame, after: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(bucket, source, target) of the buckets whose owner another ring changes; rings as in ring_owner()."""
    old = ring_owner(buckets.select(bucket).distinct(), before, bucket).withColumnRenamed("owner", "source")
    both = ring_owner(old, after, bucket).withColumnRenamed("owner", "target")
    return both.where("source <> target")


def moved_rows(table: DataFrame, plan: DataFrame, bucket: Column) -> DataFrame:
    """table's rows of migrating buckets, with source and target. The plan has a row per bucket, of which there are a few thousand."""
    rows = table.withColumn("_b", bucket)
    return rows.join(F.broadcast(plan.withColumnRenamed("bucket", "_b")), "_b").drop("_b")


def slice_split_keys(records: DataFrame, slice_: str, key: str, size: str, limit: int = SLICE_BYTES) -> DataFrame:
    """(slice, key) where slices above limit are cut: at the record with which the running size reaches total / count.

    A slice is at most a few times its limit, so its records fit one task's window with ease."""
    w = Window.partitionBy(slice_)
    run = w.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(size).over(w)
    piece = total / F.greatest(F.lit(2), F.floor(total / limit))
    before = F.sum(size).over(run) - F.col(size)
    rows = records.withColumn("_t", total).withColumn("_part", F.floor(before / piece))
    return rows.where(F.col("_t") > limit).groupBy(slice_, "_part").agg(F.min(key).alias("start")).where("_part > 0").select(slice_, "start")


def delete_outside(table: DataFrame, key: str, start: object, end: object = None) -> DataFrame:
    """Rows of a range only."""
    out = table.where(F.col(key) >= start)
    return out if end is None else out.where(F.col(key) < end)


def kick_out(table: DataFrame, *, low: object = None, high: object = None, key: str = "k", bucket: int | None = None, deleted: bool = False) -> DataFrame:
    """table without what a clean removes: a range of keys, a bucket, or deleted rows."""
    gone = F.lit(True)
    if low is not None:
        gone = gone & (F.col(key) >= low)
    if high is not None:
        gone = gone & (F.col(key) < high)
    if bucket is not None:
        gone = gone & (fn.bucket(F.col(key)) == bucket)
    if deleted:
        gone = gone & (F.col("op") == "D")
    return table.where(~gone)
