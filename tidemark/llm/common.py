"""Helpers shared by the training-data operators: shared-folder tables, row splits and components."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import pickle
import re
import sys
import tempfile
import threading
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Worker code travels with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words as the contracts define them: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share. Only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: Held while a table is written: shuffle files go with the write, so that a job's disk is that of its largest step,
#: and batches for Python are bounded by bytes, as texts may be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


class Scopes(threading.local):
    """A thread's open scratch scopes, the innermost last; each lists the tables written in it."""

    def __init__(self):
        self.open: list[list[str]] = []

    def __reduce__(self):  # worker code that travels with the plan opens none
        return Scopes, ()


_scopes = Scopes()


def materialise(df: DataFrame, codec: str = "lz4", outer: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins plain scans on both sides, so that
    adaptive execution may split a skewed key. The table goes with the scratch scope that it was written in (outer:
    with the one around that), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    schema = df.schema
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fs, target = _file(spark, path)
    fs.deleteOnExit(target)
    scopes = _scopes.open[:-1] if outer else _scopes.open
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again."""
    while paths:
        fs, target = _file(spark, paths.pop())
        fs.delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A scope whose tables are deleted at its end; what it returns must be written, by materialise(outer=True)."""
    _scopes.open.append([])
    try:
        yield
    finally:
        discard(spark, _scopes.open.pop())


@contextlib.contextmanager
def collected(paths: list[str]):
    """A scope whose tables are listed in paths, for the caller to discard."""
    _scopes.open.append(paths)
    try:
        yield
    finally:
        _scopes.open.pop()


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs meets an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def fold_of(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def worker_cache(name: str, make):
    """An object kept for the life of a Python worker, made on first use."""
    holder = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if name not in holder:
        holder[name] = make()
    return holder[name]


def digest(thing) -> str:
    """A name for the content of a picklable object."""
    return hashlib.sha256(pickle.dumps(thing)).hexdigest()


def give_back() -> None:
    """Hand memory that a worker's last batches have left free back to the system, as idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column) -> list[bytes]:
    """A batch's text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges; root is the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, shortens the pointers once, and contracts the
    edges to those between different pointers; it ends when no edge is left. All tables are written to the
    shared folder between steps, so no link set reaches the driver and hub nodes are split by AQE."""
    left = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        onto = hooks.select(F.col("a").alias("x"), F.col("p").alias("y"))
        hooks = materialise(hooks.join(onto, F.col("p") == F.col("x"), "left").select("a", F.coalesce("y", "p").alias("p")))
        onto = hooks.select(F.col("a").alias("x"), F.col("p").alias("y"))
        if found is None:
            found = hooks.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            found = materialise(found.join(onto, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root")))
        half = left.join(onto, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        left = materialise(half.join(onto, F.col("b") == F.col("x")).select("a", F.col("y").alias("b")).where("a <> b").distinct())
    if found is None:
        found = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
