"""Structured Streaming twins of replay, commands, statistics and watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import statistics
from tidemark.sources import Table


def change_feed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of a change log as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay_into(feed: DataFrame, table: Table, checkpoint: str, schema_ts: int = 0):
    """Write a feed (keys, payload, commit_ts, op) into a table's log; a batch that is repeated after a failure adds
    nothing, as its number stands in the manifest of the commit that took it."""

    def take(batch: DataFrame, number: int) -> None:
        version = table.version()
        m = table.manifest(version)
        if m.get("batch", -1) >= number:
            return
        rows = batch.where(F.col("commit_ts") >= schema_ts)
        top = rows.agg(F.max("commit_ts")).first()[0]
        if top is None:
            return
        columns = [c for c in table.log(version).columns]
        name = table._write(rows.select(*columns), "log")
        after = m | {"log": [*m["log"], name], "clock": max(m["clock"], top), "batch": number}
        if m["indexes"]:  # replayed changes may be of any age, so entries follow from the rows
            whole = table._read([*after["log"], *m["base"], *m["archive"]], f"{m['schema']}, commit_ts long, op string")
            after["entries"] = table._rebuilt(after, whole)
        table._publish(version + 1, after)

    return feed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def newest_versions(feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running newest version per key (complete or update mode)."""
    rest = [c for c in feed.columns if c not in keys]
    return feed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("commit_ts")).alias("_r")).select(*keys, "_r.*")


def windowed_counts(feed: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Changes per operation and window; rows later than `late` behind the watermark are left out."""
    return feed.withWatermark(time, late).groupBy(F.window(time, width), "op").agg(F.count(F.lit(1)).alias("changes"))


def fold_stream(commands: DataFrame, key: str, order: str, state_type: str, step: Callable[[Any, dict], Any], expected: str = "obj_version") -> DataFrame:
    """Objects' states as their commands arrive in any order of batches: a command that expects a version which isn't
    there yet waits in the state; one at or below the object's version is dropped.

    Commands are dealt by key; a batch's commands of an object come in chunks and are sorted once gathered."""
    kind = commands.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import json

        import pandas as pd

        version, value, waiting = json.loads(state.get[0]) if state.exists else (0, None, [])
        for frame in frames:
            waiting += json.loads(frame.drop(columns=[key]).to_json(orient="records"))
        waiting.sort(key=lambda c: c[order])
        kept = []
        for c in waiting:
            if c[order] <= version:
                continue
            if not kept and c[expected] == version:
                value, version = step(value, c), c[order]
            else:
                kept.append(c)
        state.update((json.dumps([version, value, kept]),))
        yield pd.DataFrame({key: [group[0]], "version": [version], "state": [value]})

    return commands.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, version long, state {state_type}", "held string", "update", GroupStateTimeout.NoTimeout)


def sampled(feed: DataFrame, pool: str, key: str, capacity: int = statistics.POOL, seed: int = 0) -> DataFrame:
    """(pool, records, sample): a uniform sample of each pool's keys as rows (pool, key, op) come; op D deletes, others insert.

    A pool's state is its bounded sample; pools, such as a table's ranges, are dealt to tasks."""
    kinds = [feed.schema[c].dataType.simpleString() for c in (pool, key)]

    def run(group: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import json

        import pandas as pd

        held = statistics.RandomPairing.load(json.loads(state.get[0])) if state.exists else statistics.RandomPairing(capacity, seed)
        for frame in frames:
            for k, op in zip(frame[key].tolist(), frame["op"].tolist(), strict=True):
                held.delete(k) if op == "D" else held.insert(k)
        state.update((json.dumps(held.dump()),))
        yield pd.DataFrame({pool: [group[0]], "records": [held.records], "sample": [held.kept]})

    return feed.select(pool, key, "op").groupBy(pool).applyInPandasWithState(run, f"{pool} {kinds[0]}, records long, sample array<{kinds[1]}>", "held string", "update", GroupStateTimeout.NoTimeout)
