"""Queries over the sample tables. A change log comes from events: user_id is the key, ts the commit timestamp, errors
are deletions. The SQL next to each query is a plain statement of what it computes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import feeds, indexes, locks, partitions, ranking, scan, statistics, versions, writes
from tidemark.sources import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86_400_000_000
#: 2024-01-10, -15 and -22 in microseconds.
T1, T2, T3 = 1_704_844_800_000_000, 1_705_276_800_000_000, 1_705_881_600_000_000
K = ["k"]
LOG = "WITH log AS (SELECT user_id AS k, epoch_us(ts) AS commit_ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, event_id FROM events)"
LATEST = "ROW_NUMBER() OVER (PARTITION BY k ORDER BY commit_ts DESC, event_id DESC)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), fn.micros(F.col("ts")).alias("commit_ts"), F.when(gone, "D").otherwise("U").alias("op"),
        F.when(~gone, F.col("value")).alias("v"), "event_id",
    )


# Versions


@query(f"{LOG} SELECT k, commit_ts, v, event_id FROM (SELECT *, {LATEST} AS rn FROM log WHERE commit_ts <= {T2}) WHERE rn = 1 AND op <> 'D'")
def asof_snapshot(spark, sf_dir):
    return versions.as_of(change_log(spark, sf_dir), K, T2, tie="event_id")


@query(f"{LOG} SELECT k, commit_ts, CASE WHEN op = 'D' THEN NULL ELSE v END AS v, CASE WHEN op = 'D' THEN 'Deleted' ELSE 'Normal' END AS status FROM (SELECT *, {LATEST} AS rn FROM log WHERE commit_ts <= {T2}) WHERE rn = 1")
def asof_with_tombstones(spark, sf_dir):
    return versions.as_of(change_log(spark, sf_dir), K, T2, tombstones=True, tie="event_id").drop("event_id")




@query(f"""{LOG}, probe AS (SELECT o_orderkey, o_custkey AS k, {T1} + (o_orderkey % 40) * {DAY // 2} AS probe_ts FROM orders)
SELECT o_orderkey, k, probe_ts, seen_ts, seen_op, v FROM (SELECT p.*, l.commit_ts AS seen_ts, l.op AS seen_op, l.v, ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY l.commit_ts DESC) AS rn
FROM probe p LEFT JOIN log l ON l.k = p.k AND l.commit_ts <= p.probe_ts) WHERE rn = 1""")
def asof_join_probe(spark, sf_dir):
    probe_ts = (F.lit(T1) + (F.col("o_orderkey") % 40) * (DAY // 2)).alias("probe_ts")
    probes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), probe_ts)
    return versions.as_of_join(probes, change_log(spark, sf_dir).drop("event_id"), K, "probe_ts", 7 * DAY)


STATUS_SQL = "{log}, s AS (SELECT k, MAX(CASE WHEN commit_ts <= {t} THEN commit_ts END) AS seen, ARG_MAX(op, commit_ts) FILTER (commit_ts <= {t}) AS op FROM log GROUP BY k) SELECT k, CASE WHEN op = 'D' THEN 'Deleted' WHEN seen IS NOT NULL THEN 'Normal' WHEN {c} = 0 THEN 'VersionUnknown' WHEN {c} <= {t} THEN 'BaseVersionMiss' ELSE 'ArchiveVersionMiss' END AS status, COALESCE(seen, 1) AS commit_ts FROM s"
EARLY = 1_704_153_600_000_000  # 2024-01-02


@query(" UNION ALL ".join(f"SELECT {c} AS checkpoint_ts, * FROM (" + STATUS_SQL.format(log=LOG, t=EARLY, c=c) + ")" for c in (0, EARLY - 1, EARLY + 1)))
def version_status(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return feeds.union_all([versions.visible_status(log, K, EARLY, c).withColumn("checkpoint_ts", F.lit(c).cast("long")) for c in (0, EARLY - 1, EARLY + 1)])


@query(f"{LOG} SELECT k, MIN(commit_ts) <= {EARLY} AS has_visible FROM log GROUP BY k")
def has_visible(spark, sf_dir):
    return versions.has_visible(change_log(spark, sf_dir), K, EARLY)


@query(f"{LOG} SELECT k, COUNT(*) - 1 AS archives FROM log GROUP BY k")
def version_archive_counts(spark, sf_dir):
    return versions.archive_counts(change_log(spark, sf_dir), K)


@query(f"{LOG} SELECT k, commit_ts, op FROM (SELECT *, MAX(CASE WHEN commit_ts <= {T2} THEN commit_ts END) OVER (PARTITION BY k) AS edge FROM log) WHERE commit_ts > {T2} OR commit_ts = edge")
def version_gc(spark, sf_dir):
    return versions.collect_garbage(change_log(spark, sf_dir), K, T2).select("k", "commit_ts", "op")


CHECKPOINT_SQL = "{log}, seen AS (SELECT *, MAX(commit_ts) OVER (PARTITION BY k) AS base FROM log WHERE commit_ts <= {t}) SELECT k, commit_ts, op, CASE WHEN commit_ts = base THEN 'base' ELSE 'archive' END AS target FROM seen WHERE base > {c} AND (commit_ts = base OR (commit_ts >= {c} AND commit_ts <> 1))"


@query(f"SELECT k, commit_ts, op FROM ({CHECKPOINT_SQL.format(log=LOG, t=T3, c=0)}) WHERE target = 'base'")
def checkpoint_base(spark, sf_dir):
    return versions.checkpoint(change_log(spark, sf_dir), K, T3).where("target = 'base'").select("k", "commit_ts", "op")


@query(f"SELECT k, commit_ts, op, target FROM ({CHECKPOINT_SQL.format(log=LOG, t=T3, c=T2)})")
def checkpoint_archive(spark, sf_dir):
    return versions.checkpoint(change_log(spark, sf_dir), K, T3, T2).select("k", "commit_ts", "op", "target")


@query(f"{LOG} SELECT k, commit_ts, op, event_id FROM log WHERE commit_ts > {T3}")
def dirty_rows(spark, sf_dir):
    return versions.dirty(change_log(spark, sf_dir), T3).select("k", "commit_ts", "op", "event_id")


@query(f"{LOG} SELECT k, commit_ts, event_id FROM log WHERE commit_ts >= {T3}")
def archives_since(spark, sf_dir):
    return versions.archives_since(change_log(spark, sf_dir), T3).select("k", "commit_ts", "event_id")


@query("SELECT event_type, MIN(epoch_us(ts)) AS min_start_ts FROM events GROUP BY event_type UNION ALL SELECT NULL, MIN(epoch_us(ts)) FROM events")
def min_active_ts(spark, sf_dir):
    return versions.min_active(table(spark, sf_dir, "events").select("event_type", fn.micros(F.col("ts")).alias("start_ts")), "event_type", "start_ts")


@query(f"{LOG} SELECT k, MAX(commit_ts) AS commit_ts FROM log WHERE k % 3 = 0 GROUP BY k HAVING MAX(commit_ts) > {T3}")
def snapshot_write_conflicts(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return versions.snapshot_conflicts(log, log.where("k % 3 = 0"), K, T3)


@query(f"{LOG} SELECT k, commit_ts, op, event_id FROM (SELECT * FROM log UNION ALL SELECT k, commit_ts + 1000, op, v, event_id FROM log WHERE event_id % 2 = 0) ")
def add_archives(spark, sf_dir):
    log = change_log(spark, sf_dir)
    more = log.where("event_id % 2 = 0").withColumn("commit_ts", F.col("commit_ts") + 1000)
    return versions.add_archives(log, more.unionByName(log), K).select("k", "commit_ts", "op", "event_id")


# Replay and write sets


@query(f"{LOG}, both_ AS (SELECT k, commit_ts, op, event_id FROM log UNION ALL SELECT k, commit_ts + {DAY}, 'U', event_id + 1000000 FROM log WHERE k % 2 = 0 AND commit_ts >= {T1}) SELECT k, commit_ts, op, event_id FROM (SELECT *, {LATEST} AS rn FROM both_) WHERE rn = 1")
def lww_replay(spark, sf_dir):
    log = change_log(spark, sf_dir).select("k", "commit_ts", "op", "event_id")
    shifted = log.where((F.col("k") % 2 == 0) & (F.col("commit_ts") >= T1)).select("k", (F.col("commit_ts") + DAY).alias("commit_ts"), F.lit("U").alias("op"), (F.col("event_id") + 1_000_000).alias("event_id"))
    return feeds.last_writer_wins(log, shifted, K, tie="event_id")


WRITES = "WITH c AS (SELECT user_id AS k, event_id AS seq, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op FROM events)"


@query(f"""{WRITES}, p AS (SELECT *, LAG(op) OVER (PARTITION BY k ORDER BY seq) AS b FROM c)
SELECT k, MAX(seq) AS seq, CASE WHEN MAX(CASE WHEN b || op IN ('UI', 'DU', 'DD') THEN 1 ELSE 0 END) = 1 THEN 'X' WHEN ARG_MAX(op, seq) = 'D' THEN 'D' WHEN ARG_MIN(op, seq) = 'I' AND MAX(CASE WHEN b || op = 'DI' THEN 1 ELSE 0 END) = 0 THEN 'I' ELSE 'U' END AS op FROM p GROUP BY k""")
def writeset_fold(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"))
    return writes.compose(changes, K, "seq")


@query("SELECT user_id, CAST(SUM(LENGTH(props)) AS BIGINT) AS bytes, SUM(LENGTH(props)) > 600 AS over_limit FROM events GROUP BY user_id")
def writeset_limit(spark, sf_dir):
    return writes.over_limit(table(spark, sf_dir, "events"), "user_id", F.length("props").cast("long"), 600)


PENDING_SQL = "SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 6 = 0 THEN 'D' ELSE 'U' END AS pop, o_totalprice + 1 AS pp FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey - 1 + 3000000, 'U', o_totalprice FROM orders WHERE o_orderkey % 50 = 7"
OVERLAY_SQL = f"SELECT COALESCE(o_orderkey, pk) AS o_orderkey, COALESCE(version, 1) AS version, CASE WHEN pop = 'D' THEN 'Deleted' ELSE 'Normal' END AS status, CASE WHEN pop = 'D' THEN NULL WHEN pop IS NOT NULL THEN pp ELSE o_totalprice END AS o_totalprice FROM (SELECT o_orderkey, o_totalprice, o_custkey + 2 AS version FROM orders) b FULL JOIN ({PENDING_SQL}) w ON o_orderkey = pk"


def _orders_and_writes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = orders.select("o_orderkey", "o_totalprice", (F.col("o_custkey") + 2).alias("version"))
    own = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "D").otherwise("U").alias("op"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = orders.where("o_orderkey % 50 = 7").select((F.lit(3_000_000 - 1) - F.col("o_orderkey")).alias("o_orderkey"), F.lit("U").alias("op"), "o_totalprice")
    return base, own.unionByName(new)


@query(f"SELECT * FROM ({OVERLAY_SQL}) WHERE o_orderkey > 300")
def overlay_scan_fwd(spark, sf_dir):
    base, own = _orders_and_writes(spark, sf_dir)
    return scan.overlay(base, own, "o_orderkey", low=300, low_inclusive=False)


@query(f"SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS rn FROM ({OVERLAY_SQL}) WHERE o_orderkey <= 300")
def overlay_scan_bwd(spark, sf_dir):
    base, own = _orders_and_writes(spark, sf_dir)
    return ranking.numbered(scan.overlay(base, own, "o_orderkey", low=300, backward=True), "o_orderkey", backward=True)  # the order is part of the result


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def tombstone_mask(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    entries = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "D").otherwise("U").alias("op"))
    return scan.mask(orders.select("o_orderkey", "o_custkey", "o_totalprice"), entries, "o_orderkey")


# Scans


@query(" UNION ALL ".join(f"SELECT '{n}' AS bounds, o_orderkey, o_totalprice FROM orders WHERE o_orderkey {a} 100 AND o_orderkey {b} 900" for n, a, b in (("[]", ">=", "<="), ("[)", ">=", "<"), ("(]", ">", "<="), ("()", ">", "<"))))
def range_scan_incl_excl(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return feeds.union_all([scan.scan(orders, "o_orderkey", 100, 900, n[0] == "[", n[1] == "]", ordered=False).withColumn("bounds", F.lit(n)) for n in ("[]", "[)", "(]", "()")])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 50")
def key_only_scan(spark, sf_dir):
    return scan.scan(table(spark, sf_dir, "orders"), "o_orderkey", low=50, keys_only=True)


@query("SELECT o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey < 500")
def record_only_scan(spark, sf_dir):
    return scan.scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey", high=500, backward=True, records_only=True)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE 'red %' OR regexp_full_match(p_name, '.*r.[a-m]g')")
def pattern_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return part.where(fn.matches(F.col("p_name"), "red *") | fn.matches(F.col("p_name"), "*r?[a-m]g"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def type_filter_scan(spark, sf_dir):
    return scan.filter_objects(table(spark, sf_dir, "events"), kind="event_type", object_type="purchase").select("event_id", "user_id", "value")


NOW_MS = T3 // 1000


@query(f"SELECT event_id, user_id FROM events WHERE event_id % 5 = 0 OR epoch_us(ts) // 1000 + 604800000 >= {NOW_MS}")
def ttl_scan(spark, sf_dir):
    ttl = F.when(F.col("event_id") % 5 != 0, F.floor(fn.micros(F.col("ts")) / 1000) + 604_800_000)
    return scan.filter_objects(table(spark, sf_dir, "events"), ttl_ms=ttl, now_ms=NOW_MS).select("event_id", "user_id")


@query(f"{LOG} SELECT k, commit_ts, op, event_id FROM log WHERE NOT (op = 'D' AND commit_ts <= {T2})")
def durable_tombstone_filter(spark, sf_dir):
    return scan.drop_durable_tombstones(change_log(spark, sf_dir), T2).select("k", "commit_ts", "op", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 10 AND l_quantity > 40 AND l_returnflag = 'R'")
def store_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return scan.store_scan(rows, "l_orderkey", 10, True, [("l_quantity", ">", "40", "Numeric"), ("l_returnflag", "=", "R", "String")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("WITH w AS (SELECT doc_id AS ord, (doc_id * 37) % 50000 AS o_orderkey FROM labels) SELECT ord, w.o_orderkey, o_totalprice, CASE WHEN o.o_orderkey IS NULL THEN 'Deleted' ELSE 'Normal' END AS status FROM w LEFT JOIN orders o ON o.o_orderkey = w.o_orderkey")
def multi_get(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), ((F.col("doc_id") * 37) % 50000).alias("o_orderkey"))
    return scan.multi_get(wanted, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("SELECT r_regionkey, r_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey")
def replicated_read(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_nationkey")


@query("SELECT o_orderstatus, COUNT(*) AS entries, CAST(SUM(CASE WHEN prev > o_custkey THEN 1 ELSE 0 END) AS BIGINT) AS faults FROM (SELECT *, LAG(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS prev FROM orders) GROUP BY o_orderstatus")
def verify_ordering(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", F.col("o_orderkey").alias("pos"))
    return scan.ordering_faults(rows, "o_custkey", "o_orderstatus")


# Indexes


def _versioned_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("commit_ts", fn.micros(F.col("o_orderdate")))


@query("SELECT o_custkey AS sk, o_orderkey AS pk, epoch_us(o_orderdate) AS commit_ts FROM orders")
def secondary_index_build(spark, sf_dir):
    return indexes.build(_versioned_orders(spark, sf_dir), "o_orderkey", "o_custkey", ordered=True)


@query("SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n]+')) AS sk, doc_id AS pk, doc_id + 1 AS commit_ts FROM documents")
def multikey_index_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("commit_ts", F.col("doc_id") + 1)
    return indexes.build(docs, "doc_id", F.split("text", r"[ \t\n]+"), many=True)


@query("SELECT o_custkey AS sk, o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 60")
def index_lookup(spark, sf_dir):
    base = _versioned_orders(spark, sf_dir)
    return indexes.lookup(indexes.build(base, "o_orderkey", "o_custkey"), base.select("o_orderkey", "o_totalprice", "commit_ts"), "o_orderkey", 10, 60).select("sk", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS sk, o_orderkey AS pk FROM orders WHERE o_custkey = 77")
def covering_index(spark, sf_dir):
    return indexes.covering(indexes.build(_versioned_orders(spark, sf_dir), "o_orderkey", "o_custkey"), 77)


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS entries FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def unique_violations(spark, sf_dir):
    return indexes.unique_violations(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


# Commit and locks


@query(f"{LOG}, r AS (SELECT k, MAX(commit_ts) AS v FROM log WHERE commit_ts <= {T1} GROUP BY k), s AS (SELECT k, MAX(commit_ts) AS v FROM log WHERE commit_ts <= {T2} GROUP BY k) SELECT r.k, r.v AS first_version, s.v AS last_version FROM r JOIN s USING (k) WHERE r.v <> s.v")
def repeatable_read_check(spark, sf_dir):
    log = change_log(spark, sf_dir)
    reads = feeds.union_all([versions.as_of(log, K, t, tombstones=True, tie="event_id").select("k", F.col("commit_ts").alias("version")) for t in (T1, T2)])
    return writes.unstable_reads(reads, K, "version")


@query(f"{LOG}, r AS (SELECT k, MAX(commit_ts) AS version FROM log WHERE commit_ts <= {T1} GROUP BY k), c AS (SELECT k, MAX(commit_ts) AS commit_ts FROM log GROUP BY k) SELECT k, version, commit_ts FROM r JOIN c USING (k) WHERE version <> commit_ts")
def read_validation(spark, sf_dir):
    log = change_log(spark, sf_dir)
    reads = versions.as_of(log, K, T1, tombstones=True, tie="event_id").select("k", F.col("commit_ts").alias("version"))
    return writes.invalid_reads(reads, versions.newest(log, K, "event_id"), K, "version")


@query(f"SELECT GREATEST((SELECT MAX(epoch_us(ts)) + 1 FROM events WHERE user_id % 4 = 0), (SELECT MAX(epoch_us(ts)) + 501 FROM events WHERE user_id % 4 = 1), {T2}) AS commit_ts")
def commit_ts(spark, sf_dir):
    log = change_log(spark, sf_dir)
    written = log.where("k % 4 = 0").select(F.lit(5).cast("long").alias("last_validation_ts"), "commit_ts")
    read = log.where("k % 4 = 1").select((F.col("commit_ts") + 500).alias("version"))
    return writes.commit_ts(7, T2, written, read)


def _values(name: str, items) -> str:
    return f"(VALUES {', '.join(f'({x!r})' for x in items)}) AS {name}_({name})"


@query(
    f"SELECT operation, level, protocol, covering, CASE operation WHEN 'Write' THEN 'WriteLock' WHEN 'ReadForWrite' THEN 'WriteIntent' "
    "WHEN 'ReadSkIndex' THEN CASE WHEN level = 'Snapshot' OR (level = 'ReadCommitted' AND covering) THEN 'NoLock' ELSE 'ReadLock' END "
    "ELSE CASE WHEN level IN ('ReadCommitted', 'Snapshot') THEN 'NoLock' WHEN protocol = 'Locking' THEN 'ReadLock' ELSE 'ReadIntent' END END AS lock "
    f"FROM {_values('operation', writes.OPERATIONS)}, {_values('level', writes.LEVELS)}, {_values('protocol', writes.PROTOCOLS)}, (VALUES (true), (false)) AS c(covering)"
)
def lock_type_matrix(spark, sf_dir):
    return writes.lock_matrix(spark)


LOCK_NAMES = ("NoLock", "ReadIntent", "ReadLock", "WriteIntent", "WriteLock")


@query(f"SELECT held, wanted FROM {_values('held', LOCK_NAMES)}, {_values('wanted', LOCK_NAMES)} WHERE (held || wanted) IN ('ReadLockWriteLock', 'WriteLockReadLock', 'WriteIntentWriteIntent', 'WriteIntentWriteLock', 'WriteLockWriteIntent', 'WriteLockWriteLock')")
def lock_conflicts(spark, sf_dir):
    pairs = spark.createDataFrame([(a, b) for a in LOCK_NAMES for b in LOCK_NAMES], "held string, wanted string")
    return pairs.where(writes.conflicts(F.col("held"), F.col("wanted")))


# Blocks of 24 events are 8 transactions over 6 entries, so the graph has a bounded degree at any size.
LOCKS_SQL = "SELECT event_id // 24 * 8 + user_id % 8 AS tx, event_id // 24 * 6 + event_id % 6 AS entry, CASE WHEN event_type = 'purchase' THEN 'holding' ELSE 'waiting' END AS state FROM events WHERE event_type IN ('purchase', 'view')"
EDGES_SQL = f"l AS ({LOCKS_SQL}), e AS (SELECT DISTINCT w.tx AS waiter, h.tx AS holder FROM l w JOIN l h ON w.entry = h.entry AND w.state = 'waiting' AND h.state = 'holding' AND w.tx <> h.tx)"
CYCLES_SQL = f"""WITH RECURSIVE {EDGES_SQL}, p AS (SELECT [waiter, holder] AS path, holder AS at FROM e WHERE waiter < holder
UNION ALL SELECT list_append(p.path, e.holder), e.holder FROM p JOIN e ON p.at = e.waiter WHERE e.holder > p.path[1] AND NOT list_contains(p.path, e.holder)),
c AS (SELECT p.path AS cycle, CAST(len(p.path) AS INT) AS length FROM p JOIN e ON p.at = e.waiter AND e.holder = p.path[1])"""


def _locks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    block = F.floor(F.col("event_id") / 24)
    return rows.select((block * 8 + F.col("user_id") % 8).alias("tx"), (block * 6 + F.col("event_id") % 6).alias("entry"), F.when(F.col("event_type") == "purchase", "holding").otherwise("waiting").alias("state"))


def _told(found: DataFrame) -> DataFrame:
    return found.withColumn("cycle", F.array_join(F.col("cycle").cast("array<string>"), ">"))


@query(f"WITH {EDGES_SQL} SELECT waiter, holder FROM e")
def deadlock_edges(spark, sf_dir):
    return locks.wait_for(_locks(spark, sf_dir))


@query(f"{CYCLES_SQL} SELECT array_to_string(cycle, '>') AS cycle, length FROM c")
def deadlock_cycles(spark, sf_dir):
    return _told(locks.cycles(locks.wait_for(_locks(spark, sf_dir))))


@query(f"{CYCLES_SQL}, n AS (SELECT tx, COUNT(*) AS n FROM l WHERE state = 'holding' GROUP BY tx), x AS (SELECT cycle, length, unnest(cycle) AS tx FROM c) SELECT array_to_string(cycle, '>') AS cycle, length, victim FROM (SELECT cycle, length, x.tx AS victim, ROW_NUMBER() OVER (PARTITION BY cycle ORDER BY COALESCE(n, 0), x.tx) AS rn FROM x LEFT JOIN n ON n.tx = x.tx) WHERE rn = 1")
def deadlock_victims(spark, sf_dir):
    held = _locks(spark, sf_dir)
    return _told(locks.victims(locks.cycles(locks.wait_for(held)), held))


@query("SELECT c_custkey, 100 + 5 * (ROW_NUMBER() OVER (ORDER BY c_custkey) - 1) AS id FROM customer")
def auto_increment(spark, sf_dir):
    return writes.auto_increment(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 5)


# Statistics

SAMPLE_SQL = "s AS (SELECT DISTINCT o_custkey AS x FROM orders ORDER BY (o_custkey * 7919) % 10007, o_custkey LIMIT 1024)"
STEPS_SQL = f"{SAMPLE_SQL}, r AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) - 1 AS i, COUNT(*) OVER () AS n FROM s), st AS (SELECT CAST(CASE WHEN n <= 128 THEN i ELSE i // (n // 128) END AS INT) AS step, x FROM r WHERE n <= 128 OR (i % (n // 128) = 0 AND i // (n // 128) < 128))"


def _sample(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("x"))
    return statistics.bottom_sample(x, "x", order=(F.col("x") * 7919) % 10007)


@query(f"WITH {STEPS_SQL} SELECT step, x FROM st")
def histogram_steps(spark, sf_dir):
    return statistics.steps(_sample(spark, sf_dir), "x")


RANGES = [(0, 10), (5, 5), (10, 500), (33, 34), (100, 1200), (-5, 100000), (700, 20)]
BELOW_SQL = "(SELECT (COUNT(*) FILTER (st.x < {p}) + CASE WHEN COUNT(*) FILTER (st.x = {p}) > 0 THEN 1.0 ELSE 0.5 END) / (COUNT(*) + 1.0) FROM st)"


@query(f"WITH {STEPS_SQL}, q AS (SELECT * FROM (VALUES {', '.join(map(str, RANGES))}) AS v(low, high)), w AS (SELECT low, high, CASE WHEN high <= low THEN 0.0 ELSE {BELOW_SQL.format(p='q.high')} - {BELOW_SQL.format(p='q.low')} END AS sel FROM q) SELECT low, high, ROUND(CAST(sel AS DOUBLE), 6) AS selectivity, CAST(FLOOR(CAST(sel AS DOUBLE) * 15000 + 0.000001) AS BIGINT) AS est_rows FROM w")
def range_selectivity(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "low int, high int")
    found = statistics.range_rows(statistics.steps(_sample(spark, sf_dir), "x"), ranges, "x", 15000)
    return found.select("low", "high", F.round("selectivity", 6).alias("selectivity"), F.floor(F.col("selectivity") * 15000 + 0.000001).cast("long").alias("est_rows"))


@query(
    "WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem ORDER BY (l_orderkey * 7919 + l_linenumber * 31) % 10007, l_orderkey, l_linenumber LIMIT 1024), c AS (SELECT COUNT(*) AS s, COUNT(DISTINCT l_orderkey) AS a FROM s), t AS (SELECT COUNT(*) AS t FROM lineitem), x AS (SELECT 1 AS prefix, a AS ndv, s FROM c UNION ALL SELECT 2, s, s FROM c) "
    "SELECT prefix, ndv, CAST(FLOOR((GREATEST(t, s) - 1) * (ndv - 1) / (s - 1) + 1) AS BIGINT) AS scaled_ndv, ROUND(GREATEST(t, s) / FLOOR((GREATEST(t, s) - 1) * (ndv - 1) / (s - 1) + 1), 6) AS rec_per_key FROM x, t"
)
def records_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    sample = statistics.bottom_sample(rows, "l_orderkey", "l_linenumber", order=(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 10007)
    return statistics.records_per_key(sample, rows.count(), "l_orderkey", "l_linenumber").withColumn("rec_per_key", F.round("rec_per_key", 6))


NAMES = ("customer", "nation", "orders", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS records FROM {n}" for n in NAMES))
def table_counts(spark, sf_dir):
    return statistics.table_counts({n: table(spark, sf_dir, n) for n in NAMES})


@query("SELECT MAX(epoch_us(ts)) AS last_commit_ts FROM events")
def last_commit_ts(spark, sf_dir):
    return change_log(spark, sf_dir).agg(F.max("commit_ts").alias("last_commit_ts"))


@query("WITH w AS (SELECT c_nationkey, COUNT(*) AS w FROM customer GROUP BY 1), x AS (SELECT c_nationkey, ROW_NUMBER() OVER (ORDER BY c_nationkey) AS i, COUNT(*) OVER () AS n, CAST(FLOOR(100003.0 * w / SUM(w) OVER ()) AS BIGINT) AS share FROM w) SELECT c_nationkey, CAST(CASE WHEN i < n THEN share ELSE 100003 - (SELECT SUM(share) FROM x WHERE i < n) END AS BIGINT) AS records FROM x")
def divide_records(spark, sf_dir):
    weights = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("w"))
    return statistics.divide(100_003, weights, "c_nationkey", "w")


@query("WITH s AS (SELECT l_orderkey // 64 AS slice, COUNT(*) AS n FROM lineitem GROUP BY 1), v AS (SELECT COUNT(*) AS visited_slices, SUM(n) AS visited_keys FROM s WHERE slice % 5 = 0) SELECT visited_slices, CAST(visited_keys AS BIGINT) AS visited_keys, CAST(CEIL((SELECT COUNT(*) FROM s) * visited_keys / visited_slices) AS BIGINT) AS records FROM v")
def slice_estimate(spark, sf_dir):
    slices = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 64).alias("slice")).agg(F.count(F.lit(1)).alias("keys"))
    return statistics.estimate_records(slices.where("slice % 5 = 0"), slices.count())


# Partitions


@query("SELECT o_orderkey, o_orderkey % 4096 AS bucket FROM orders")
def bucket_assign(spark, sf_dir):
    return partitions.with_bucket(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


RING = partitions.ring(5)
RING_SQL = f"(VALUES {', '.join(map(str, RING))}) AS r(position, node_group)"


@query(f"WITH b AS (SELECT DISTINCT o_orderkey % 4096 AS bucket FROM orders), f AS (SELECT bucket, (SELECT MIN(position) FROM {RING_SQL} WHERE position > bucket) AS p FROM b) SELECT bucket, node_group AS owner FROM f JOIN {RING_SQL} ON position = COALESCE(p, {RING[0][0]})")
def ring_owner(spark, sf_dir):
    buckets = partitions.with_bucket(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("bucket").distinct()
    return partitions.ring_owner(buckets, spark.createDataFrame(RING, "position long, node_group int"))


STARTS = [(i * i * 40 + 10, i) for i in range(20)]
STARTS_SQL = f"(VALUES {', '.join(map(str, STARTS))}) AS r(range_start, range_id)"


@query(f"SELECT o_orderkey, range_start, range_id FROM orders ASOF LEFT JOIN {STARTS_SQL} ON o_orderkey >= range_start")
def range_floor_lookup(spark, sf_dir):
    ranges = spark.createDataFrame(STARTS, "range_start int, range_id int")
    return partitions.floor_lookup(table(spark, sf_dir, "orders").select("o_orderkey"), ranges, "o_orderkey", "range_start")


@query(f"SELECT user_id // 16 AS slice, CAST(SUM(CASE WHEN event_type = 'error' THEN 0 ELSE LENGTH(props) END - 8) AS BIGINT) AS delta FROM events WHERE epoch_us(ts) > {T2} GROUP BY 1")
def slice_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(fn.micros(F.col("ts")) > T2)
    new = F.when(F.col("event_type") == "error", 0).otherwise(F.length("props"))
    return partitions.slice_delta(rows, F.floor(F.col("user_id") / 16), F.lit(8), new)


@query(f"WITH {SAMPLE_SQL}, r AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) - 1 AS i, GREATEST(1, COUNT(*) OVER () // 11) AS step FROM s) SELECT CAST(i // step AS INT) AS pick, x FROM r WHERE i % step = 0 AND i // step BETWEEN 1 AND 10")
def subrange_keys(spark, sf_dir):
    return partitions.sub_range_keys(_sample(spark, sf_dir), "x", 10)


SPLIT_SQL = "WITH s AS (SELECT l_orderkey // 100 AS slice, COUNT(*) * 120 AS bytes FROM lineitem GROUP BY 1), c AS (SELECT *, COALESCE(SUM(bytes) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(bytes) OVER () AS total FROM s), p AS (SELECT *, CASE WHEN total > 200000 THEN CEIL(total / 20000) ELSE 1 END AS parts FROM c)"


@query(f"{SPLIT_SQL} SELECT CAST(LEAST(FLOOR(before * parts / total), parts - 1) AS INT) AS part, MIN(slice) AS start, CAST(SUM(bytes) AS BIGINT) AS bytes, COUNT(*) AS slices FROM p GROUP BY 1")
def range_split_plan(spark, sf_dir):
    slices = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 100).alias("slice")).agg((F.count(F.lit(1)) * 120).alias("bytes"))
    return partitions.split_plan(slices, "slice", "bytes", 200_000)


# Commands and feeds


@query("WITH c AS (SELECT conv_id, turn, role, LENGTH(text) > 700 AS overwrites FROM conversations), x AS (SELECT *, MAX(CASE WHEN overwrites THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM c) SELECT conv_id, turn, role FROM x WHERE cut IS NULL OR turn >= cut")
def cmd_log_compact(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") > 700).alias("overwrites"))
    return feeds.compact_commands(rows, "conv_id", "turn", "overwrites").select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(role || ':' || LENGTH(text), ',' ORDER BY turn) AS items FROM conversations GROUP BY conv_id")
def cmd_fold_append(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.length("text")).alias("item"))
    return feeds.fold_append(rows, "conv_id", "turn", "item").withColumn("items", F.array_join("items", ","))


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 3 THEN turn - 2 ELSE turn - 1 END AS expected FROM conversations), g AS (SELECT *, SUM(CASE WHEN expected <> COALESCE(prev, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS broken FROM (SELECT *, LAG(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM c)) SELECT conv_id, turn FROM g WHERE broken = 0")
def cmd_chain(spark, sf_dir):
    expected = F.when((F.col("conv_id") + F.col("turn")) % 5 == 3, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", expected.alias("expected"), F.lit(False).alias("ignores"))
    return feeds.applicable(rows, "conv_id", "expected", "turn", "ignores", start=-1).select("conv_id", "turn")


@query("WITH m AS (SELECT user_id % 8 AS grp, event_id AS seq FROM events WHERE event_type <> 'error'), a AS (SELECT grp, MAX(seq) AS max_id FROM m WHERE grp < 6 AND seq >= grp * 10 GROUP BY grp) SELECT grp, max_id, MAX(mark) AS consistent_mark FROM a LEFT JOIN (SELECT user_id % 8 AS grp, event_id AS mark FROM events WHERE event_type = 'error') USING (grp) WHERE mark <= max_id GROUP BY ALL")
def standby_consistent_ts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("grp"), "event_id", "event_type")
    start = spark.range(6).select(F.col("id").alias("grp"), (F.col("id") * 10).alias("first_id"))
    sent = events.where("event_type <> 'error'").select("grp", F.col("event_id").alias("seq"))
    return feeds.standby(sent, "grp", "seq", events.where("event_type = 'error'").select("grp", F.col("event_id").alias("mark")), start)


@query("SELECT event_id, event_type, r_name FROM events, region")
def publish_fanout(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select("event_id", "event_type")
    return feeds.publish(messages, table(spark, sf_dir, "region").select("r_name"))


# Further operators


@query("SELECT user_id, ROUND(list_reduce(list(CAST(LENGTH(props) + event_id % 7 AS DOUBLE) ORDER BY event_id), lambda a, b: a * 0.9 + b * 0.1), 6) AS average FROM events GROUP BY user_id")
def average_record_size(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", (F.length("props") + F.col("event_id") % 7).alias("n")).alias("x"))
    sizes = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return sizes.select("user_id", F.round(statistics.average_size(F.transform("x", lambda x: x["n"])), 6).alias("average"))


@query(
    "WITH r AS (SELECT o_custkey // 100 AS slice, o_orderkey AS k, 64 + o_orderkey % 9 AS n FROM orders), w AS (SELECT *, SUM(n) OVER (PARTITION BY slice) AS t, SUM(n) OVER (PARTITION BY slice ORDER BY k ROWS UNBOUNDED PRECEDING) - n AS before FROM r), "
    "p AS (SELECT *, CAST(FLOOR(before / (t / GREATEST(2, t // 16384))) AS BIGINT) AS part FROM w WHERE t > 16384) SELECT slice, MIN(k) AS start FROM p WHERE part > 0 GROUP BY slice, part"
)
def slice_split_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("slice"), F.col("o_orderkey").alias("k"), (64 + F.col("o_orderkey") % 9).alias("n"))
    return partitions.slice_split_keys(rows, "slice", "k", "n")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 9000 AND NOT (o_orderkey >= 500 AND o_orderkey < 700) AND o_orderkey % 4096 <> 17")
def range_clean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kept = partitions.delete_outside(orders, "o_orderkey", 100, 9000)
    return partitions.kick_out(partitions.kick_out(kept, low=500, high=700, key="o_orderkey"), bucket=17, key="o_orderkey")


@query(f"WITH {SAMPLE_SQL} SELECT x, CASE WHEN x >= 700 THEN 2 WHEN x >= 250 THEN 1 ELSE 0 END AS owner FROM s")
def split_sample_pool(spark, sf_dir):
    ranges = spark.createDataFrame([(0, 0), (250, 1), (700, 2)], "start int, owner int")
    return statistics.pool_owners(_sample(spark, sf_dir), ranges, "x", "start", "owner")


@query(f"WITH {SAMPLE_SQL} SELECT x FROM s WHERE x % 3 <> 0")
def prune_sample_pool(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("x"))
    return statistics.prune(_sample(spark, sf_dir), gone, "x")


@query(f"{LOG} SELECT COUNT(*) AS live_rows FROM (SELECT *, {LATEST} AS rn FROM log) WHERE rn = 1 AND op <> 'D'")
def live_row_count(spark, sf_dir):
    return versions.as_of(change_log(spark, sf_dir), K, 1 << 60, tie="event_id").agg(F.count(F.lit(1)).alias("live_rows"))


@query("SELECT doc_id, len(list_distinct(string_split(lang || ' ' || source, ' '))) AS paths, list_contains(string_split(lang || ' ' || source, ' '), 'src1') AS has_src1 FROM documents")
def multikey_paths(spark, sf_dir):
    both = indexes.merge_paths(F.array("lang"), F.array("source"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(both).cast("long").alias("paths"), indexes.contains_path(both, F.array(F.lit("src1"))).alias("has_src1"))


@query("WITH c AS (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS i, LENGTH(text) AS n FROM conversations) SELECT conv_id, CAST(SUM(CASE WHEN i % 2 = 1 THEN n ELSE -n END) AS BIGINT) AS state FROM c GROUP BY conv_id")
def cmd_fold_custom(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))

    def step(state, command):
        count, total = (0, 0) if state is None else divmod(state, 1 << 40)
        total -= 1 << 39 if state is not None else 0
        total += command["n"] if count % 2 == 0 else -command["n"]
        return (count + 1 << 40) + total + (1 << 39)

    state = feeds.fold_commands(rows, "conv_id", "turn", "long", step)
    return state.select("conv_id", (F.pmod("state", F.lit(1 << 40)) - (1 << 39)).alias("state"))


# Point reads, stored indexes and statistics, ranges that are rewritten, and buckets that move


OWN_SQL = "w AS (SELECT c_custkey * 3 AS k, CASE WHEN c_custkey % 5 = 0 THEN 'D' ELSE 'U' END AS op, c_acctbal AS total FROM customer WHERE c_custkey % 2 = 0), q AS (SELECT p_partkey * 2 AS k FROM part)"


@query(f"WITH {OWN_SQL} SELECT q.k, CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_custkey WHEN w.k IS NOT NULL THEN 1 ELSE 0 END AS version, CASE WHEN w.k IS NOT NULL THEN CASE WHEN w.op = 'D' THEN 'Deleted' ELSE 'Normal' END WHEN o.o_orderkey IS NOT NULL THEN 'Normal' ELSE 'Deleted' END AS status, CASE WHEN w.op = 'D' THEN NULL WHEN w.k IS NOT NULL THEN w.total ELSE o.o_totalprice END AS total FROM q LEFT JOIN w ON w.k = q.k LEFT JOIN orders o ON o.o_orderkey = q.k")
def point_read(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("version"), F.col("o_totalprice").alias("total"))
    own = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") * 3).alias("k"), F.when(F.col("c_custkey") % 5 == 0, "D").otherwise("U").alias("op"), F.col("c_acctbal").alias("total"))
    return scan.point_read(base, own, table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("k")), "k")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def store_point_read(spark, sf_dir):
    return scan.store_get(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), o_orderkey=77)


def _stored(spark: SparkSession, schema: str, keys: list[str], indexes_: dict[str, str] | None = None) -> Table:
    """A new table in the folder that executors share; it goes when the driver ends."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    made = Table.create(spark, f"{folder.rstrip('/')}/tidemark-table-{uuid.uuid4().hex}", schema, keys, indexes_)
    made._fs.deleteOnExit(made._path(made.path))
    return made


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS sk, o_orderkey AS pk, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 2 END AS BIGINT) AS commit_ts FROM orders WHERE o_orderkey % 11 <> 0")
def index_maintained(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = _stored(spark, "o_orderkey long, o_custkey long", ["o_orderkey"], {"by_customer": "o_custkey"})
    t.commit(orders.withColumn("op", F.lit("I")))
    gone = F.col("o_orderkey") % 11 == 0
    t.commit(orders.where((F.col("o_orderkey") % 7 == 0) | gone).select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.when(gone, "D").otherwise("U").alias("op")))
    return t.index("by_customer")


SUPPLIERS_SQL = "s AS (SELECT s_suppkey AS x FROM supplier), r AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) - 1 AS i, COUNT(*) OVER () AS n FROM s), st AS (SELECT x FROM r WHERE n <= 128 OR (i % (n // 128) = 0 AND i // (n // 128) < 128))"
PROBES = [(1, 5), (3, 3), (2, 60), (-4, 1000), (50, 20), (10, 11)]
BELOW_SQL = "((SELECT COUNT(*) FROM st WHERE x < {0}) + CASE WHEN EXISTS (SELECT 1 FROM st WHERE x = {0}) THEN 1.0 ELSE 0.5 END) / ((SELECT COUNT(*) FROM st) + 1)"


@query(f"WITH {SUPPLIERS_SQL}, p AS (SELECT low, high, CASE WHEN high <= low THEN 0.0 ELSE CAST({BELOW_SQL.format('high')} AS DOUBLE) - CAST({BELOW_SQL.format('low')} AS DOUBLE) END AS selectivity FROM (VALUES {', '.join(map(str, PROBES))}) AS v(low, high)) SELECT low, high, selectivity, CAST(FLOOR(selectivity * (SELECT COUNT(*) FROM s)) AS BIGINT) AS rows FROM p")
def stored_statistics(spark, sf_dir):
    t = _stored(spark, "s_suppkey long, s_name string", ["s_suppkey"])
    t.commit(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("I").alias("op")))
    t.analyze()
    return t.estimate(spark.createDataFrame(PROBES, "low int, high int"))


@query("SELECT DISTINCT x FROM (SELECT o_custkey AS x FROM orders UNION SELECT c_custkey FROM customer) ORDER BY (x * 7919) % 10007, x LIMIT 1024")
def merged_samples(spark, sf_dir):
    order = (F.col("x") * 7919) % 10007
    pools = [statistics.bottom_sample(table(spark, sf_dir, t).select(F.col(c).alias("x")), "x", order=order) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"))]
    return statistics.bottom_sample(pools[0].unionByName(pools[1]), "x", order=order)


@query(f"{SPLIT_SQL}, q AS (SELECT slice, CAST(LEAST(FLOOR(before * parts / total), parts - 1) AS INT) AS part FROM p) SELECT part, COUNT(*) AS rows, MIN(l_orderkey) AS low, MAX(l_orderkey) AS high FROM lineitem JOIN q ON l_orderkey // 100 = slice GROUP BY part")
def range_rewrite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_orderkey") / 100).alias("slice"))
    plan = partitions.split_plan(lines.groupBy("slice").agg((F.count(F.lit(1)) * 120).alias("bytes")), "slice", "bytes", 200_000)
    rewritten = partitions.rewrite_ranges(lines, "slice", plan)
    return rewritten.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("SELECT l_orderkey // 1000 AS range_id, MIN(l_orderkey) AS start, MAX(l_orderkey) AS last, COUNT(DISTINCT l_orderkey // 50) AS slices, COUNT(*) AS records, CAST(SUM(64 + l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def range_metadata(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_orderkey") / 1000).alias("range_id"), F.floor(F.col("l_orderkey") / 50).alias("slice"), (F.col("l_linenumber") + 64).alias("n"))
    return partitions.range_metadata(lines, "l_orderkey", "range_id", "slice", "n")


U32 = "& 4294967295"
#: The hash of one 32-bit block, step by step in 128-bit integers.
MURMUR_SQL = f"""k1 AS (SELECT id, (id::HUGEINT * 3432918353) {U32} AS k FROM (SELECT DISTINCT l_orderkey // 1000 AS id FROM lineitem)),
k2 AS (SELECT id, ((((k << 15) | (k >> 17)) {U32}) * 461845907) {U32} AS k FROM k1), h1 AS (SELECT id, xor(9001::HUGEINT, k) AS h FROM k2),
h2 AS (SELECT id, xor(((((h << 13) | (h >> 19)) {U32}) * 5 + 3864292196) {U32}, 4::HUGEINT) AS h FROM h1), h3 AS (SELECT id, (xor(h, h >> 16) * 2246822507) {U32} AS h FROM h2),
h4 AS (SELECT id, (xor(h, h >> 13) * 3266489909) {U32} AS h FROM h3)"""


@query(f"WITH {MURMUR_SQL} SELECT id AS range_id, CAST(xor(h, h >> 16) % 4096 AS BIGINT) AS bucket FROM h4")
def range_buckets(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("range_id")).distinct()
    return ids.withColumn("bucket", partitions.range_bucket(F.col("range_id")))


GROWN = partitions.ring(6)
GROWN_SQL = f"(VALUES {', '.join(map(str, GROWN))}) AS g(position, node_group)"


@query(f"WITH b AS (SELECT o_orderkey % 4096 AS bucket, COUNT(*) AS n FROM orders GROUP BY 1), f AS (SELECT bucket, n, (SELECT MIN(position) FROM {RING_SQL} WHERE position > bucket) AS p, (SELECT MIN(position) FROM {GROWN_SQL} WHERE position > bucket) AS q FROM b) SELECT r.node_group AS source, g.node_group AS target, CAST(SUM(n) AS BIGINT) AS rows FROM f JOIN {RING_SQL} ON r.position = COALESCE(p, {RING[0][0]}) JOIN {GROWN_SQL} ON g.position = COALESCE(q, {GROWN[0][0]}) WHERE r.node_group <> g.node_group GROUP BY 1, 2")
def bucket_migration(spark, sf_dir):
    rows = partitions.with_bucket(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    before, after = (spark.createDataFrame(r, "position long, node_group int") for r in (RING, GROWN))
    plan = partitions.migration(rows, before, after)
    return partitions.moved_rows(rows, plan, F.col("bucket")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("rows"))


@query("WITH c AS (SELECT c_custkey AS command, unnest([c_custkey % 10 + 1, c_custkey + 1, c_custkey]) AS k, generate_subscripts([1, 2, 3], 1) AS i FROM customer) SELECT command, array_to_string(list(COALESCE(o.c_name, '-') ORDER BY i), ',') AS names FROM c LEFT JOIN customer o ON o.c_custkey = k GROUP BY command")
def multi_object_read(spark, sf_dir):
    objects = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    commands = objects.select(F.col("c_custkey").alias("command"), F.array(F.col("c_custkey") % 10 + 1, F.col("c_custkey") + 1, F.col("c_custkey")).alias("wanted"))
    found = feeds.multi_object(commands, objects, "command", "wanted", "c_custkey")
    return found.select("command", F.array_join(F.transform("objects", lambda x: F.coalesce(x["c_name"], F.lit("-"))), ",").alias("names"))


@query("SELECT user_id, ts_us, op FROM (SELECT user_id, epoch_us(ts) AS ts_us, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, event_id FROM events) WHERE event_id <> 42")
def revert_pending_write(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", fn.micros(F.col("ts")).alias("ts_us"), F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"))
    return writes.revert_write(rows, ["event_id"], event_id=42).drop("event_id")
