"""Replay, object commands, standby feeds and publishing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import versions


def last_writer_wins(base: DataFrame, more: DataFrame, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """Newest version per key of both; uploads at timestamps up to 1 are skipped, and equal ones keep base's."""
    both = base.withColumn("_own", F.lit(1)).unionByName(more.where("commit_ts > 1").withColumn("_own", F.lit(0)))
    rest = [c for c in both.columns if c not in keys]
    order = F.struct("commit_ts", "_own", tie) if tie else F.struct("commit_ts", "_own", *[c for c in rest if c not in ("commit_ts", "_own")])
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").drop("_own")


def replay(log: DataFrame, records: DataFrame, keys: Sequence[str], schema_ts: int = 0, owned: Column | None = None, multi_version: bool = True) -> DataFrame:
    """The log with replayed records: those before the schema or of keys that aren't owned are skipped.

    With versions kept, records join the versions (equal timestamps once, so that replay may be repeated); without,
    the newest of each key stays."""
    records = records.where(F.col("commit_ts") >= schema_ts)
    records = records if owned is None else records.where(owned)
    return versions.add_archives(log, records, keys) if multi_version else last_writer_wins(log, records, keys)


def compact_commands(commands: DataFrame, key: str, version: str, overwrite: str) -> DataFrame:
    """Commands of each object without those before its last overwriting one, and without repeated versions.

    The cut is an aggregate joined back, so no object's commands are gathered."""
    last = commands.where(F.col(overwrite)).groupBy(key).agg(F.max(version).alias("_cut"))
    kept = commands.join(last, key, "left").where(F.col("_cut").isNull() | (F.col(version) >= F.col("_cut"))).drop("_cut")
    return kept.dropDuplicates([key, version])


def applicable(commands: DataFrame, key: str, expected: str, version: str, ignores: str, start: int = 0) -> DataFrame:
    """Commands that apply in order: each expects the version that the one before left, unless it ignores it; a gap
    ends its object's chain, until a command that ignores what came before."""
    order = Window.partitionBy(key).orderBy(version)
    before = F.coalesce(F.lag(version).over(order), F.lit(start))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = commands.withColumn("_gap", (~F.col(ignores) & (F.col(expected) != before)).cast("int"))
    rows = rows.withColumn("_restart", F.sum(F.col(ignores).cast("int")).over(run))
    sub = Window.partitionBy(key, "_restart").orderBy(version).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_broken", F.sum("_gap").over(sub)).where("_broken = 0").drop("_gap", "_restart", "_broken")


def fold_append(commands: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """State of objects whose commands append: the values in order. One object's state is one row by its nature."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return commands.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias("items"))


def fold_commands(commands: DataFrame, key: str, order: str, state_type: str, step: Callable[[Any, dict], Any]) -> DataFrame:
    """State of each object after its commands in order, by the caller's step(state, command) from None on.

    For semantics that built-in functions can't tell; commands reach the step a batch at a time, sorted by object
    and order, so that no object is held in memory."""
    columns = commands.columns
    kind = commands.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("state", T._parse_datatype_string(state_type))])

    def fold(frames):
        import pandas as pd

        last, state, begun = None, None, False
        for frame in frames:
            keys, states = [], []
            for row in frame.to_dict("records"):
                if begun and row[key] != last:
                    keys.append(last)
                    states.append(state)
                    state = None
                last, begun = row[key], True
                state = step(state, row)
            if keys:
                yield pd.DataFrame({key: keys, "state": states})
        if begun:
            yield pd.DataFrame({key: [last], "state": [state]})

    return commands.select(*columns).repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, schema)


def expiring(step: Callable[[Any, dict], Any], ttl: Callable[[Any], int | None], time: Callable[[dict], int]) -> Callable[[Any, dict], Any]:
    """A step for fold_commands() before which an object whose time to live lies before the command is retired."""

    def run(state: Any, command: dict) -> Any:
        end = None if state is None else ttl(state)
        return step(None if end is not None and end < time(command) else state, command)

    return run


def multi_object(commands: DataFrame, objects: DataFrame, command: str, wanted: str, key: str) -> DataFrame:
    """Each command (command, wanted: an array of keys) with `objects`, the objects it names in its order; null for those that are missing.

    A command's own objects come together in one row, however many commands name an object."""
    each = commands.select(command, F.posexplode(wanted).alias("_i", "_k"))
    held = objects.select(F.col(key).alias("_o"), F.struct(*objects.columns).alias("_v"))
    got = each.join(held, F.col("_k") == F.col("_o"), "left")
    gathered = got.groupBy(command).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"))
    return gathered.select(command, F.transform("_l", lambda x: x["_v"]).alias("objects"))


def standby(messages: DataFrame, group: str, seq: str, pending: DataFrame, start: DataFrame) -> DataFrame:
    """Per subscribed group (start: group, first_id): the largest accepted id and the largest pending mark up to it.

    Messages of other groups and ids below the subscription's first are dropped; pending marks have `mark`."""
    accepted = messages.join(start, group).where(F.col(seq) >= F.col("first_id")).groupBy(group).agg(F.max(seq).alias("max_id"))
    marks = pending.join(accepted, group).where(F.col("mark") <= F.col("max_id")).groupBy(group).agg(F.max("mark").alias("consistent_mark"))
    return accepted.join(marks, group, "left")


def publish(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """Each message for each node group, a list of groups being carried to the messages."""
    names = groups.groupBy().agg(F.array_sort(F.collect_set(groups.columns[0])).alias("_g"))
    return messages.join(F.broadcast(names)).select(*messages.columns, F.explode("_g").alias(groups.columns[0]))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
