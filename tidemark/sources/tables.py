"""Versioned tables in a folder: Parquet files and numbered manifests.

A commit writes its files first and then publishes the next manifest by creating its file, which fails if another
commit has taken the number. Readers see the newest manifest; files of aborted commits are never listed by one. All
paths are opened by Spark's file systems, so a folder may be anywhere that Spark reads and writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indexes, statistics, versions


class ConflictError(Exception):
    """A commit lost against another one, or read what has changed since."""


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _file(self, version: int):
        return self._path(f"{self.path}/_manifests/{version:020d}.json")

    def version(self) -> int:
        """Number of the newest manifest, -1 where there is none."""
        folder = self._path(f"{self.path}/_manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            raise FileNotFoundError(self.path)
        stream = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        try:
            stream = self._fs.create(self._file(version), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise ConflictError(f"version {version} of {self.path} is taken") from e
            raise
        writer = jvm.java.io.OutputStreamWriter(stream, "UTF-8")
        writer.write(json.dumps(manifest))
        writer.close()

    def _write(self, frame: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/{name}")
        return name

    # definition

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: Sequence[str], indexes_: dict[str, str] | None = None) -> Table:
        """A table of keys and payload columns; indexes: name to indexed column."""
        table = cls(spark, path)
        indexes_ = {k: {"column": v, "unique": False} for k, v in (indexes_ or {}).items()}
        table._publish(0, {"keys": list(keys), "schema": schema, "schema_ts": 1, "log": [], "base": [], "archive": [], "indexes": indexes_, "entries": {}, "checkpoint_ts": 0, "clock": 1, "dropped": False, "statistics": {}})
        return table

    def drop(self) -> None:
        self._change(dropped=True)

    def truncate(self) -> None:
        """No rows from now on; older versions of the table still have theirs."""
        self._change(log=[], base=[], archive=[], entries={})

    def alter_indexes(self, add: dict[str, str] | None = None, drop: Sequence[str] = (), unique: Sequence[str] = ()) -> None:
        """Add indexes (name to column), built from the current snapshot in the same commit, and drop others.

        unique: names of added ones whose keys may not repeat; if they do already, nothing is added."""
        version = self.version()
        m = self.manifest(version)
        added = {name: {"column": column, "unique": name in unique} for name, column in (add or {}).items()}
        names = {k: v for k, v in m["indexes"].items() if k not in drop} | added
        entries = {k: v for k, v in m["entries"].items() if k in names}
        rows = self.snapshot(version=version)
        for name, what in added.items():
            built = rows.select(*m["keys"], F.col(what["column"]).alias("sk"), "commit_ts", F.lit("U").alias("op")).where("sk IS NOT NULL")
            if what["unique"] and not indexes.unique_violations(built, "sk").isEmpty():
                raise ConflictError(f"unique violation in index {name}")
            entries[name] = [self._write(built.repartitionByRange("sk", *m["keys"]).sortWithinPartitions("sk", *m["keys"]), f"index-{name}")]
        self._publish(version + 1, m | {"indexes": names, "entries": entries, "schema_ts": m["clock"]})

    def add_columns(self, columns: str) -> None:
        """More payload columns; rows written before have nulls there. Commits that began before fail."""
        version = self.version()
        m = self.manifest(version)
        self._publish(version + 1, m | {"schema": f"{m['schema']}, {columns}", "schema_ts": m["clock"] + 1, "clock": m["clock"] + 1})

    def _change(self, **what) -> None:
        version = self.version()
        self._publish(version + 1, self.manifest(version) | what)

    # reading

    def _read(self, names: Sequence[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def log(self, version: int | None = None) -> DataFrame:
        """All versions of all rows: keys, payload, commit_ts, op."""
        m = self.manifest(version)
        if m["dropped"]:
            raise FileNotFoundError(f"{self.path} is dropped")
        return self._read([*m["log"], *m["base"], *m["archive"]], f"{m['schema']}, commit_ts long, op string")

    def snapshot(self, ts: int | None = None, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return versions.as_of(self.log(version), m["keys"], m["clock"] if ts is None else ts)

    def _entries(self, m: dict, name: str) -> DataFrame:
        """All versions of an index's entries: keys, sk, commit_ts, op."""
        fields = {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], m["schema"]).schema.fields}
        keys = ", ".join(f"`{k}` {fields[k]}" for k in m["keys"])
        return self._read(m["entries"].get(name, []), f"{keys}, sk {fields[m['indexes'][name]['column']]}, commit_ts long, op string")

    def index(self, name: str, ts: int | None = None, version: int | None = None) -> DataFrame:
        """Entries (sk, pk, commit_ts) of a stored index as of a timestamp; pk is the key, or a struct of several."""
        m = self.manifest(version)
        live = versions.as_of(self._entries(m, name), ["sk", *m["keys"]], m["clock"] if ts is None else ts)
        pk = F.col(m["keys"][0]) if len(m["keys"]) == 1 else F.struct(*m["keys"])
        return live.select("sk", pk.alias("pk"), "commit_ts")

    def _rebuilt(self, m: dict, log: DataFrame) -> dict[str, list[str]]:
        """Files of all indexes, built from the newest rows of a log."""
        rows, out = versions.as_of(log, m["keys"], m["clock"]), {}
        for name, what in m["indexes"].items():
            built = rows.select(*m["keys"], F.col(what["column"]).alias("sk"), "commit_ts", F.lit("U").alias("op")).where("sk IS NOT NULL")
            out[name] = [self._write(built, f"index-{name}")]
        return out

    def _index_changes(self, m: dict, version: int, name: str, rows: DataFrame, ts: int) -> DataFrame:
        """Entries that rows (one change per key) add and delete; a unique index takes none that repeat its keys."""
        keys, what = m["keys"], m["indexes"][name]
        old = self.snapshot(version=version).join(rows.select(*keys), keys, "left_semi").select(*keys, F.col(what["column"]).alias("sk")).where("sk IS NOT NULL")
        new = rows.where("op <> 'D'").select(*keys, F.col(what["column"]).alias("sk")).where("sk IS NOT NULL")
        gone, more = old.join(new, [*keys, "sk"], "left_anti"), new.join(old, [*keys, "sk"], "left_anti")
        if what["unique"]:
            live = versions.as_of(self._entries(m, name), ["sk", *keys], m["clock"]).select(*keys, "sk")
            then = live.join(gone, [*keys, "sk"], "left_anti").join(more.select("sk").distinct(), "sk", "left_semi").unionByName(more)
            if not indexes.unique_violations(then, "sk").isEmpty():
                raise ConflictError(f"unique violation in index {name}")
        stamp = F.lit(ts).cast("long").alias("commit_ts")
        return gone.select(*keys, "sk", stamp, F.lit("D").alias("op")).unionByName(more.select(*keys, "sk", stamp, F.lit("U").alias("op")))

    def _key_schema(self, m: dict, keys: Sequence[str]) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], m["schema"]).schema.fields if f.name in keys)

    def statistics(self) -> tuple[dict, DataFrame]:
        """(facts, sample): what analyze() stored, with `stale`, whether a sixteenth of the records has changed since.

        Statistics that were stored without steps count as none."""
        m = self.manifest()
        found = m["statistics"]
        if "steps" not in found:
            raise LookupError(f"{self.path} has no statistics")
        changed = self.log().where(F.col("commit_ts") > found["clock"]).count()
        return found | {"stale": changed > found["records"] // 16}, self._read([found["sample"]], self._key_schema(m, m["keys"]))

    def estimate(self, ranges: DataFrame) -> DataFrame:
        """ranges (low, high) with `selectivity` and `rows` by the stored steps of the first key; nothing is in an empty table."""
        found, m = self.statistics()[0], self.manifest()
        key = m["keys"][0]
        steps = self._read([found["steps"]], self._key_schema(m, [key]))
        return statistics.range_rows(steps, ranges, key, found["records"]).withColumn("selectivity", F.coalesce("selectivity", F.lit(0.0)))

    def drop_statistics(self) -> None:
        self._change(statistics={})

    @staticmethod
    def refresh_statistics(tables: Sequence[Table]) -> list[str]:
        """Analyze again those tables that have none or that have changed since; returns their paths."""
        todo = [t for t in tables if "steps" not in (m := t.manifest())["statistics"] or m["statistics"]["clock"] != m["clock"]]
        for t in todo:
            t.analyze()
        return [t.path for t in todo]

    def warm(self) -> DataFrame:
        """The current snapshot, held in the executors' memory and disk until unpersist()."""
        return self.snapshot().persist()

    # writing

    def commit(self, changes: DataFrame, read_version: int | None = None, reads: DataFrame | None = None, unique: bool = False) -> int:
        """Append changes (keys, payload, op) at one new timestamp and return it.

        read_version: the table version that the changes are based on; if rows that are written or among `reads` (keys)
        have changed since, the commit fails, otherwise it is tried again on top of what was committed meanwhile."""
        seen = self.version() if read_version is None else read_version
        base = self.manifest(seen)
        keys, columns = base["keys"], [f.name for f in self.spark.createDataFrame([], base["schema"]).schema.fields]
        if unique and not self.snapshot(version=seen).join(changes.where("op = 'I'").select(*keys), keys, "left_semi").isEmpty():
            raise ConflictError("an inserted key is there already")
        staged = self._write(changes.select(*columns, "op"), "staged")
        while True:
            version = self.version()
            m = self.manifest(version)
            if m["schema_ts"] != base["schema_ts"]:
                raise ConflictError("the schema has changed")
            if version > seen:
                touched = changes.select(*keys) if reads is None else changes.select(*keys).unionByName(reads.select(*keys))
                newer = self.log(version).where(F.col("commit_ts") > base["clock"])
                if not newer.join(touched.distinct(), keys, "left_semi").isEmpty():
                    raise ConflictError("rows that were read or written have changed")
            ts = m["clock"] + 1
            rows = self.spark.read.schema(f"{m['schema']}, op string").parquet(f"{self.path}/{staged}")
            entries = {k: [*m["entries"].get(k, []), self._write(self._index_changes(m, version, k, rows, ts), f"index-{k}")] for k in m["indexes"]}
            name = self._write(rows.select(*columns, F.lit(ts).cast("long").alias("commit_ts"), "op"), "log")
            try:
                self._publish(version + 1, m | {"log": [*m["log"], name], "clock": ts, "entries": entries})
                return ts
            except ConflictError:
                continue

    def checkpoint(self, oldest_active: int | None = None) -> None:
        """Rewrite the log as base (newest versions) and archive (older ones that a reader from oldest_active on may see)."""
        version = self.version()
        m = self.manifest(version)
        to_ts = m["clock"]
        kept = versions.collect_garbage(self.log(version), m["keys"], to_ts if oldest_active is None else oldest_active)
        rows = versions.checkpoint(kept, m["keys"], to_ts)
        columns = self.log(version).columns
        oldest = to_ts if oldest_active is None else oldest_active
        entries = {k: [self._write(versions.collect_garbage(self._entries(m, k), ["sk", *m["keys"]], oldest).where(f"op <> 'D' OR commit_ts > {oldest}"), f"index-{k}")] for k in m["indexes"]}
        base = self._write(rows.where("target = 'base' AND (op <> 'D' OR commit_ts > {})".format(to_ts if oldest_active is None else oldest_active)).select(*columns), "base")
        archive = self._write(rows.where("target = 'archive'").select(*columns), "archive")
        self._publish(version + 1, m | {"log": [], "base": [base], "archive": [archive], "checkpoint_ts": to_ts, "entries": entries})

    def analyze(self) -> dict:
        """Record count, sampled keys and the first key's steps among all keys of the snapshot, stored with the table.

        Keys are written once and read from there, so that versions are compared once."""
        version = self.version()
        m = self.manifest(version)
        first = m["keys"][0]
        staged = [self._write(self.snapshot(version=version).select(*m["keys"]), "staged")]
        rows = self._read(staged, self._key_schema(m, m["keys"]))
        records = rows.count()
        sample = self._write(statistics.bottom_sample(rows, *m["keys"]), "sample")
        staged.append(self._write(statistics.in_order(rows, first), "staged"))
        ordered = self._read(staged[1:], f"{self._key_schema(m, [first])}, _at long")
        steps = self._write(statistics.whole_steps(ordered, first), "steps")
        for name in staged:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        found = {"records": records, "sample": sample, "steps": steps, "clock": m["clock"]}
        self._publish(version + 1, m | {"statistics": found})
        return found

    def backup(self, path: str, version: int | None = None) -> Table:
        """A copy of one version of the table in another folder, rewritten as one set of files with its own manifest."""
        m = self.manifest(version)
        copy = Table(self.spark, path)
        name = copy._write(self.log(version), "log")
        entries = {k: [copy._write(self._entries(m, k), f"index-{k}")] for k in m["indexes"]}
        copy._publish(0, m | {"log": [name], "base": [], "archive": [], "entries": entries, "statistics": {}})
        return copy

    def vacuum(self, keep: int = 1) -> int:
        """Delete files that the newest `keep` manifests don't list, and older manifests; returns how many folders went.

        Not while commits run: files that they have staged are listed nowhere yet."""
        newest = self.version()
        oldest = max(0, newest - keep + 1)
        listed: set[str] = set()
        for v in range(oldest, newest + 1):
            m = self.manifest(v)
            listed |= {*m["log"], *m["base"], *m["archive"], *(n for e in m["entries"].values() for n in e), m["statistics"].get("sample", ""), m["statistics"].get("steps", "")}
        gone = 0
        for kind in self._fs.listStatus(self._path(self.path)):
            if kind.isDirectory() and kind.getPath().getName() != "_manifests":
                for entry in self._fs.listStatus(kind.getPath()):
                    if f"{kind.getPath().getName()}/{entry.getPath().getName()}" not in listed:
                        gone += bool(self._fs.delete(entry.getPath(), True))
        for v in range(oldest):
            self._fs.delete(self._file(v), False)
        return gone

    @staticmethod
    def discover(spark: SparkSession, folder: str) -> list[str]:
        """Names of the tables in a folder."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []
        return sorted(n for n in names if (t := Table(spark, f"{folder}/{n}")).version() >= 0 and not t.manifest()["dropped"])
