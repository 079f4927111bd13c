"""Deadlock detection: the wait-for graph, its cycles, and victims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wait_for(locks: DataFrame, entry: str = "entry", tx: str = "tx", state: str = "state") -> DataFrame:
    """Edges (waiter, holder) of transactions that wait for an entry that another one holds; locks has a row per
    transaction and entry with state holding or waiting."""
    held = locks.where(F.col(state) == "holding").select(entry, F.col(tx).alias("holder")).distinct()
    waits = locks.where(F.col(state) == "waiting").select(entry, F.col(tx).alias("waiter")).distinct()
    return waits.join(held, entry).where("waiter <> holder").select("waiter", "holder").distinct()


def gather(*lock_tables: DataFrame) -> DataFrame:
    """Lock sets of all node groups as one."""
    return reduce(DataFrame.unionByName, lock_tables).distinct()


def kept(frame: DataFrame) -> DataFrame:
    """frame, computed once: checkpointed where the session has a folder for that, which outlives lost executors, else persisted."""
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return frame.checkpoint()
    return frame.persist()


def trim(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges without those whose waiter nobody waits for or whose holder doesn't wait, as such are on no cycle; again
    and again until all are gone, or `rounds` times."""
    left = None
    while rounds is None or rounds > 0:
        edges = edges.join(edges.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").select("waiter", "holder")
        edges = edges.join(edges.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").select("waiter", "holder")
        if rounds is not None:
            rounds -= 1
            continue
        edges = kept(edges)
        now = edges.count()
        if now in (0, left):
            break
        left = now
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, length): each simple cycle of any length once, from its smallest transaction on.

    Paths start at their smallest transaction and only visit larger ones, each once, after edges on no cycle are gone.
    They are extended until none is open, so the work grows with the number of simple paths among what is left."""
    live = trim(edges)
    step = live.select(F.col("waiter").alias("_from"), F.col("holder").alias("_to"))
    paths = live.where("waiter < holder").select(F.array("waiter", "holder").alias("path"))
    found, length = [], 2
    while True:
        on = kept(paths.join(step, F.element_at("path", -1) == F.col("_from")).select("path", "_to"))
        found.append(on.where(F.col("_to") == F.element_at("path", 1)).select(F.col("path").alias("cycle"), F.lit(length).alias("length")))
        paths = on.where((F.col("_to") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("_to"))).select(F.array_append("path", F.col("_to")).alias("path"))
        length += 1
        if paths.isEmpty():
            return reduce(DataFrame.unionByName, found)


def victims(found: DataFrame, locks: DataFrame, tx: str = "tx", state: str = "state") -> DataFrame:
    """found with `victim`: of each cycle the transaction that holds the fewest entries, then the smallest."""
    holds = locks.where(F.col(state) == "holding").groupBy(F.col(tx).alias("_tx")).agg(F.count(F.lit(1)).alias("_n"))
    each = found.select("cycle", "length", F.explode("cycle").alias("_tx")).join(holds, "_tx", "left")
    pick = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_tx").alias("tx")))
    return each.groupBy("cycle", "length").agg(pick["tx"].alias("victim"))
