"""Table statistics: bounded samples, equi-depth steps, selectivity, records per key, record counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a sample pool, steps of a histogram.
POOL, STEPS = 1024, 128


def bottom_sample(table: DataFrame, *keys: str, size: int = POOL, order: Column | None = None) -> DataFrame:
    """`size` distinct keys with the smallest hashes: a uniform sample that doesn't depend on the order of rows.

    A top-k plan: each task keeps `size` rows at most. order replaces the hash."""
    ranked = table.select(*keys, (F.xxhash64(*keys) if order is None else order).alias("_h")).distinct()
    return ranked.orderBy("_h", *keys).limit(size).drop("_h")


def merge_samples(a: DataFrame, b: DataFrame, *keys: str, size: int = POOL) -> DataFrame:
    """Sample of two disjoint tables' union from their samples."""
    return bottom_sample(a.unionByName(b), *keys, size=size)


def merge_groups(counts: DataFrame, *samples: DataFrame, keys: Sequence[str], size: int = POOL) -> tuple[DataFrame, DataFrame]:
    """(records of each table, one sample) over node groups: counts (table_name, records) add up, and samples' keys join."""
    whole = counts.groupBy("table_name").agg(F.sum("records").alias("records"))
    both = samples[0]
    for s in samples[1:]:
        both = both.unionByName(s)
    return whole, bottom_sample(both, *keys, size=size)


def prune(sample: DataFrame, deleted: DataFrame, *keys: str) -> DataFrame:
    return sample.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


def _step(i: Column, n: Column, most: int) -> Column:
    """Which step the key with i of n keys in front of it is; null if it is none."""
    every = F.greatest(F.lit(1), F.floor(n / most))
    return F.when(n <= most, i).when((i % every == 0) & (i / every < most), i / every).cast("int")


def steps(sample: DataFrame, key: str, most: int = STEPS) -> DataFrame:
    """(step, key): the sorted distinct keys if at most `most`, else every n // most-th from the first on.

    The sample is bounded, so that one task ranks it."""
    distinct = sample.select(key).distinct()
    ranked = distinct.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    step = _step(F.col("i"), F.col("n"), most)
    return ranked.where(step.isNotNull()).select(step.alias("step"), key)


def in_order(table: DataFrame, key: str) -> DataFrame:
    """(key, _at): a table's distinct keys, sorted over all partitions, null last, with partition and place; to be written."""
    up = F.col(key).asc_nulls_last()
    return table.select(key).distinct().repartitionByRange(up).sortWithinPartitions(up).withColumn("_at", F.monotonically_increasing_id())


def whole_steps(ordered: DataFrame, key: str, most: int = STEPS) -> DataFrame:
    """(key): the steps among all of a table's keys, from what in_order() gave and was written, lest keys are dealt anew."""
    part = ordered.withColumns({"_part": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes, every = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), Window.partitionBy()  # a row a partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(every).alias("_n"))
    return part.join(F.broadcast(sizes), "_part").where(_step(F.col("_ahead") + F.col("_i"), F.col("_n"), most).isNotNull()).select(key)


def below(step_table: DataFrame, probes: DataFrame, key: str, probe: str) -> DataFrame:
    """probes with `selectivity`, the estimated share of records below each probe.

    A probe that is a step stands at its interval's end; other probes stand in its middle. The steps are at most
    STEPS rows and travel as one array."""
    packed = step_table.groupBy().agg(F.array_sort(F.collect_list(key)).alias("_s"), F.count(F.lit(1)).alias("_steps"))
    both = probes.join(F.broadcast(packed))
    n = F.col("_steps")  # _s has no null key
    lower = F.size(F.filter("_s", lambda x: x < F.col(probe)))
    place = F.when(F.get("_s", lower) == F.col(probe), 1.0).otherwise(0.5)
    return both.withColumn("selectivity", F.when(n == 0, F.lit(None)).otherwise((lower + place) / (n + 1))).drop("_s", "_steps")


def range_rows(step_table: DataFrame, ranges: DataFrame, key: str, records: int) -> DataFrame:
    """ranges (low, high) with `selectivity` and `rows` of [low, high): records / 100 without steps."""
    low = below(step_table, ranges, key, "low").withColumnRenamed("selectivity", "_low")
    both = below(step_table, low, key, "high").withColumnRenamed("selectivity", "_high")
    share = F.when(F.col("_high").isNotNull(), F.when(F.col("high") <= F.col("low"), 0.0).otherwise(F.col("_high") - F.col("_low")))
    rows = F.coalesce(F.floor(share * records), F.floor(F.lit(records) / 100)).cast("long")
    return both.withColumns({"selectivity": share, "rows": rows}).drop("_low", "_high")


def records_per_key(sample: DataFrame, records: int, *keys: str) -> DataFrame:
    """One row per prefix length of keys: distinct prefixes in the sample scaled to the table (truncated), and records per prefix."""
    counts = sample.agg(F.count_distinct(F.struct(*keys)).alias("s"), *[F.count_distinct(F.struct(*keys[: i + 1])).alias(f"n{i + 1}") for i in range(len(keys))])
    each = counts.select("s", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("prefix"), F.col(f"n{i + 1}").alias("ndv")) for i in range(len(keys))])).alias("x")).select("s", "x.*")
    total = F.greatest(F.lit(records), F.col("s"))
    scaled = F.when(F.col("s") <= 1, F.lit(1)).otherwise(F.floor((total - 1) * (F.col("ndv") - 1) / (F.col("s") - 1) + 1)).cast("long")
    return each.select("prefix", "ndv", scaled.alias("scaled_ndv"), F.when(total == 0, 1.0).otherwise(total / scaled).alias("rec_per_key"))


def divide(total: int, weights: DataFrame, key: str, weight: str) -> DataFrame:
    """total apportioned by weights in order of key: truncated shares, the last takes what remains."""
    order, every = Window.orderBy(key), Window.partitionBy()
    w = weights.select(key, weight, F.sum(weight).over(every).alias("_all"), F.row_number().over(order).alias("_i"), F.count(F.lit(1)).over(every).alias("_n"))
    share = F.floor(F.lit(total) * F.col(weight) / F.col("_all")).cast("long")
    w = w.withColumn("_share", F.when(F.col("_i") < F.col("_n"), share).otherwise(0))
    return w.select(key, F.when(F.col("_i") < F.col("_n"), F.col("_share")).otherwise(F.lit(total) - F.sum("_share").over(every)).alias("records"))


def estimate_records(slices: DataFrame, total_slices: int) -> DataFrame:
    """Records of a table from the key counts of visited slices (one row each, `keys`): rounded up."""
    n = F.count(F.lit(1))
    return slices.agg(n.alias("visited_slices"), F.sum("keys").alias("visited_keys"), F.ceil(F.lit(total_slices) * F.sum("keys") / n).cast("long").alias("records"))


def needs_rebuild(upserts: Column, records: Column) -> Column:
    return upserts > F.floor(records / 16)


def average_size(sizes: Column) -> Column:
    """Moving average of record sizes in order of arrival: the first as it is, then 0.1 new + 0.9 old."""
    return F.aggregate(sizes, F.lit(None).cast("double"), lambda old, new: F.coalesce(old * 0.9 + new * 0.1, new.cast("double")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("table_name"), "records") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pool_owners(sample: DataFrame, ranges: DataFrame, key: str, start: str, owner: str) -> DataFrame:
    """Sample keys with the owner of the range that holds them, for moving samples when ranges are split."""
    from tidemark.operators.partitions import floor_lookup

    return floor_lookup(sample, ranges, key, start).select(key, owner)


class RandomPairing:
    """A bounded uniform sample under inserts and deletes, for state kept between batches.

    Deletions are paired with later insertions: a deletion from the sample leaves a place that a later insertion
    fills with the chance it had."""

    def __init__(self, capacity: int = POOL, seed: int = 0):
        import random

        self.capacity, self.random = capacity, random.Random(seed)
        self.kept: list = []
        self.place: dict = {}
        self.records = self.gone_in = self.gone_out = self.upserts = 0

    def _put(self, key) -> None:
        self.place[key] = len(self.kept)
        self.kept.append(key)

    def _drop(self, key) -> None:
        at, last = self.place.pop(key), self.kept.pop()
        if last != key:
            self.kept[at] = last
            self.place[last] = at

    def insert(self, key) -> None:
        self.records += 1
        self.upserts += 1
        if key in self.place:
            return
        waiting = self.gone_in + self.gone_out
        if waiting:
            if self.random.randrange(waiting) < self.gone_in:
                self.gone_in -= 1
                self._put(key)
            else:
                self.gone_out -= 1
        elif len(self.kept) < self.capacity:
            self._put(key)
        elif (at := self.random.randrange(self.records)) < self.capacity:
            self._drop(self.kept[at])
            self._put(key)

    def delete(self, key) -> None:
        sampled = key in self.place
        if sampled:
            self._drop(key)
        # A deletion waits for an insertion to pair with, told apart by where it took its key from.
        self.gone_in, self.gone_out = self.gone_in + sampled, self.gone_out + (not sampled)
        self.records = max(0, self.records - 1)
        self.upserts += 1

    def dump(self) -> dict:
        """All that is needed to go on in another process."""
        return {"capacity": self.capacity, "kept": self.kept, "counts": [self.records, self.gone_in, self.gone_out, self.upserts], "seed": self.random.randrange(1 << 62)}

    @classmethod
    def load(cls, held: dict) -> RandomPairing:
        pool = cls(held["capacity"], held["seed"])
        for key in held["kept"]:
            pool._put(key)
        pool.records, pool.gone_in, pool.gone_out, pool.upserts = held["counts"]
        return pool
