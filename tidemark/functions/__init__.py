"""Column functions: key patterns, time, record status, locks and key hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL, DELETED, UNKNOWN = "Normal", "Deleted", "Unknown"
VERSION_UNKNOWN, BASE_MISS, ARCHIVE_MISS = "VersionUnknown", "BaseVersionMiss", "ArchiveVersionMiss"
#: Commit timestamps of an entry never filled, and of one that doesn't exist.
NEVER_FILLED, NOT_THERE = 0, 1
BUCKETS = 4096


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    seconds = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + seconds


def glob_regex(pattern: str) -> str:
    """A regular expression for a key pattern: * any run, ? one letter, [...] a set ([^...] or [!...] its complement)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out += "[" + inner.replace("\\", r"\\") + "]"
            i = close
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def matches(key: Column, pattern: str) -> Column:
    """Whether key has the pattern; an empty pattern takes all. A plain prefix becomes startsWith, which scans push down."""
    if not pattern:
        return F.lit(True)
    if re.fullmatch(r"[^*?\[\\]*\*", pattern):
        return key.startswith(pattern[:-1])
    if not re.search(r"[*?\[\\]", pattern):
        return key == pattern
    return key.rlike(glob_regex(pattern))


def alive(ttl_ms: Column, now_ms: int) -> Column:
    """Objects without a time to live stay; others until it lies before now."""
    return ttl_ms.isNull() | (ttl_ms >= now_ms)


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a numeric key; other keys go by xxhash64."""
    return F.pmod(key, F.lit(buckets))


def hashed_bucket(*key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets))


def node_group(shard_code: Column) -> Column:
    return F.shiftright(shard_code, 10)


def leader_core(table_hash: Column, cores: int) -> Column:
    return F.pmod(table_hash.bitwiseAND(F.lit(0x3FF)), F.lit(cores))


def leader_group(table_hash: Column, groups: int) -> Column:
    return F.pmod(F.shiftright(table_hash, 10), F.lit(groups))


def miss_status(checkpoint_ts: Column, read_ts: Column) -> Column:
    """Status of a key of which no version in memory is visible: where its version has to be looked for."""
    return F.when(checkpoint_ts == 0, VERSION_UNKNOWN).when(checkpoint_ts <= read_ts, BASE_MISS).otherwise(ARCHIVE_MISS)
