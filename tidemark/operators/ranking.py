"""Ranks and running sums over a whole table without a task that sees it all, and searches in sorted arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a table is cut into, and keys that are looked at to find where.
PARTS, LOOKED_AT = 64, 4096


def cut_points(rows: DataFrame, order: str, parts: int = PARTS, sample: int = LOOKED_AT) -> list:
    """Up to parts - 1 keys that cut rows into parts of about equal numbers of distinct keys, from a sample of `sample`
    keys by their hash; keys of any type that has an order. Only balance depends on it."""
    keys = rows.select(order).where(F.col(order).isNotNull()).distinct()
    found = sorted(r[0] for r in keys.orderBy(F.xxhash64(order)).limit(sample).collect())
    return found[len(found) // parts :: max(1, len(found) // parts)][: parts - 1] if len(found) > 1 else []


def count_up_to(values: Column, x: Column, most: int) -> Column:
    """How many elements of a sorted array of at most `most` elements aren't above x, by binary search; null for a null x."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = (acc["low"] < acc["high"]) & F.coalesce(F.get(values, mid) <= x, F.lit(False))
        return F.struct(F.when(right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(right | (acc["low"] >= acc["high"]), acc["high"]).otherwise(mid).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length() + 1)))
    return F.when(x.isNotNull(), F.aggregate(steps, begin, halve, lambda acc: acc["low"]))


def with_part(rows: DataFrame, order: str, cuts: Sequence, name: str = "_part") -> DataFrame:
    """rows with the number of the part that their key falls into; null keys come first."""
    if not cuts:
        return rows.withColumn(name, F.lit(0))
    keys = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{rows.schema[order].dataType.simpleString()}>")
    return rows.withColumn(name, F.coalesce(count_up_to(keys, F.col(order), len(cuts)), F.lit(0)))


def running(rows: DataFrame, order: str, **sums: str | Column) -> DataFrame:
    """rows with each of sums, by name, added up over the rows in front in order of a column, and the whole sum as name_all.

    Each part's rows are summed in a window of their own, and parts' totals, a row each, are put in front."""
    parted = with_part(rows, order, cut_points(rows, order))
    totals = parted.groupBy("_part").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    ahead, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # PARTS rows
    zero = F.lit(0)
    totals = totals.select("_part", *[F.coalesce(F.sum(k).over(ahead), zero).alias(f"_ahead_{k}") for k in sums], *[F.sum(k).over(every).alias(f"{k}_all") for k in sums])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(totals), "_part")
    own = {k: F.col(f"_ahead_{k}") + F.coalesce(F.sum(v).over(within), zero) for k, v in sums.items()}
    return out.withColumns(own).drop("_part", *[f"_ahead_{k}" for k in sums])


def numbered(rows: DataFrame, order: str, name: str = "rn", backward: bool = False) -> DataFrame:
    """rows with their number from 1 in order of a column, forward or backward."""
    out = running(rows, order, _n=F.lit(1).cast("long"))
    place = F.col("_n_all") - F.col("_n") if backward else F.col("_n") + 1
    return out.withColumn(name, place.cast("long")).drop("_n", "_n_all")
