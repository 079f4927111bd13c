"""Secondary indexes: building, unique checks, look-ups, covering reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(base: DataFrame, primary: str, secondary: Column | str, many: bool = False, scan_ts: int | None = None, ordered: bool = False) -> DataFrame:
    """Entries (sk, pk, commit_ts) of base rows (with commit_ts, and op where rows may be deleted) up to scan_ts.

    secondary: the indexed expression; with many, an array of which each distinct element gets an entry. Null keys
    get none. ordered: entries dealt by ranges of their key and sorted, as files of an index should be."""
    rows = base if scan_ts is None else base.where(F.col("commit_ts") <= scan_ts)
    if "op" in rows.columns:
        rows = rows.where("op <> 'D'")
    sk = F.col(secondary) if isinstance(secondary, str) else secondary
    sk = F.explode(F.array_distinct(sk)) if many else sk
    out = rows.select(sk.alias("sk"), F.col(primary).alias("pk"), "commit_ts").where(F.col("sk").isNotNull())
    return out.repartitionByRange("sk", "pk").sortWithinPartitions("sk", "pk") if ordered else out


def encode(base: DataFrame, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entries by the caller's own encoder, a DataFrame function to (sk, pk, commit_ts)."""
    return encoder(base).select("sk", "pk", "commit_ts")


def unique_violations(entries: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one entry, and how many."""
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def lookup(index: DataFrame, base: DataFrame, primary: str, low: object = None, high: object = None) -> DataFrame:
    """Base rows of index entries in a range of keys [low, high]; entries older than their row's version are kept only
    if the row was committed no earlier than the entry."""
    if low is not None:
        index = index.where(F.col("sk") >= low)
    if high is not None:
        index = index.where(F.col("sk") <= high)
    entry = index.select("sk", F.col("pk").alias(primary), F.col("commit_ts").alias("_entry_ts"))
    return entry.join(base, primary).where(F.col("commit_ts") >= F.col("_entry_ts")).drop("_entry_ts")


def covering(index: DataFrame, sk: object) -> DataFrame:
    """Answer from the index alone."""
    return index.where(F.col("sk") == sk).select("sk", "pk")


def merge_paths(a: Column, b: Column) -> Column:
    """Union of two multikey paths."""
    return F.array_union(a, b)


def contains_path(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0
