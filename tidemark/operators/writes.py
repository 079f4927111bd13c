"""Write sets and commits: composition of changes, commit timestamps, read validation, locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import ranking

#: Fixed value: bytes that a transaction's write set may hold.
WRITE_LIMIT = 62 * 1024 * 1024


def compose(changes: DataFrame, keys: Sequence[str], order: str, unique: bool = False) -> DataFrame:
    """One net change per key of changes (keys, order, op in I, U, D, payload), with the last payload; op is E for a
    duplicate insert if unique, and X where the changes can't follow each other.

    Only the first and last change of a key and three conditions on neighbours matter, so this is one window for
    neighbours and one aggregate: net is D if the last is D; else I if the key was inserted first (or its first
    change followed nothing) and never deleted in between; an insert after a deletion is an update."""
    rest = [c for c in changes.columns if c not in keys]
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy(order))
    seen = changes.withColumn("_b", before)
    pair = F.concat(F.col("_b"), F.col("op"))
    got = seen.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_last"), F.min_by("op", order).alias("_first"),
        F.max((pair == "II").cast("int")).alias("_again"), F.max(pair.isin("UI", "DU", "DD").cast("int")).alias("_bad"), F.max((pair == "DI").cast("int")).alias("_back"),
    )
    net = F.when(F.col("_bad") == 1, "X").when((F.col("_again") == 1) & F.lit(unique), "E").when(F.col("_last.op") == "D", "D")
    net = net.when((F.col("_first") == "I") & (F.coalesce("_back", F.lit(0)) == 0), "I").otherwise("U")
    return got.select(*keys, "_last.*", net.alias("_net")).withColumn("op", F.col("_net")).drop("_net")


def over_limit(changes: DataFrame, transaction: str, size: Column, limit: int = WRITE_LIMIT) -> DataFrame:
    """Bytes of each transaction's write set and whether they exceed the limit."""
    return changes.groupBy(transaction).agg(F.sum(size).alias("bytes")).withColumn("over_limit", F.col("bytes") > limit)


def unstable_reads(reads: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keys whose versions differ between reads of one transaction; 0 needs no validation."""
    got = reads.where(F.col(version) > 0).groupBy(*keys).agg(F.min(version).alias("first_version"), F.max(version).alias("last_version"))
    return got.where("first_version <> last_version")


def invalid_reads(reads: DataFrame, current: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Reads whose recorded version (unless 0) isn't the current commit_ts."""
    now = current.select(*keys, "commit_ts")
    return reads.where(F.col(version) > 0).join(now, list(keys)).where(F.col(version) != F.col("commit_ts"))


def commit_ts(lower_bound: int, clock: int, writes: DataFrame | None = None, reads: DataFrame | None = None, catalog_ts: int = 0, commands: DataFrame | None = None) -> DataFrame:
    """One row, commit_ts: above each written key's last validation and commit, each command's object version, and each
    version read; at least the bounds and the shard's clock."""
    parts = []
    for frame, columns in ((writes, ("last_validation_ts", "commit_ts")), (commands, ("last_validation_ts", "object_version")), (reads, ("version",))):
        if frame is not None:
            parts.append(frame.agg(*[F.max(c).alias(c) for c in columns]).select(F.greatest(*[F.coalesce(c, F.lit(-1)) for c in columns], F.lit(-1)).cast("long").alias("t")))
    if not parts:
        raise ValueError("a commit needs writes, commands or reads")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.agg(F.greatest(F.max("t") + 1, F.lit(lower_bound), F.lit(clock), F.lit(catalog_ts)).cast("long").alias("commit_ts"))


LEVELS, PROTOCOLS = ("ReadCommitted", "Snapshot", "RepeatableRead", "Serializable"), ("OCC", "OccRead", "Locking")
OPERATIONS = ("ReadSkIndex", "ReadForWrite", "Write", "Read")


def lock_for(operation: Column, level: Column, protocol: Column, covering: Column) -> Column:
    """Lock that an operation takes."""
    weak = level.isin("ReadCommitted", "Snapshot")
    index = F.when((level == "Snapshot") | ((level == "ReadCommitted") & covering), "NoLock").otherwise("ReadLock")
    read = F.when(weak, "NoLock").when(protocol == "Locking", "ReadLock").otherwise("ReadIntent")
    return F.when(operation == "ReadSkIndex", index).when(operation == "ReadForWrite", "WriteIntent").when(operation == "Write", "WriteLock").otherwise(read)


def lock_matrix(spark: SparkSession) -> DataFrame:
    """The lock for every operation, level and protocol, with and without a covering index."""
    rows = [(o, i, p, c) for o in OPERATIONS for i in LEVELS for p in PROTOCOLS for c in (False, True)]
    frame = spark.createDataFrame(rows, "operation string, level string, protocol string, covering boolean")
    return frame.withColumn("lock", lock_for(*map(F.col, ("operation", "level", "protocol", "covering"))))


#: Pairs of locks that can't be held together.
CONFLICTS = (("ReadLock", "WriteLock"), ("WriteIntent", "WriteIntent"), ("WriteIntent", "WriteLock"), ("WriteLock", "WriteLock"))


def conflicts(held: Column, wanted: Column) -> Column:
    out = F.lit(False)
    for a, b in CONFLICTS:
        out = out | ((held == a) & (wanted == b)) | ((held == b) & (wanted == a))
    return out


def auto_increment(rows: DataFrame, order: str, offset: int = 1, increment: int = 1) -> DataFrame:
    """rows with `id`: offset, offset + increment, ... in the order of a column of any type.

    Rows are ranked within ranges of the order, of which each adds the sizes of those before it, so that no task
    ranks the whole table."""
    return ranking.numbered(rows, order, "_rn").withColumn("id", (F.lit(offset) + F.lit(increment) * (F.col("_rn") - 1)).cast("long")).drop("_rn")


def find_write(changes: DataFrame, keys: Sequence[str], **wanted) -> DataFrame:
    """The pending change of one key of a write set, if there is one."""
    return _of_key(changes, keys, wanted, True)


def revert_write(changes: DataFrame, keys: Sequence[str], **wanted) -> DataFrame:
    """The write set without the pending change of one key."""
    return _of_key(changes, keys, wanted, False)


def _of_key(changes: DataFrame, keys: Sequence[str], wanted: dict, same: bool) -> DataFrame:
    if set(keys) != set(wanted):
        raise ValueError(f"a key has values for {', '.join(keys)}")
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & F.col(k).eqNullSafe(F.lit(v))
    return changes.where(hit if same else ~hit)
