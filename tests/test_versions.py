"""Golden vectors of versions, garbage collection and checkpoints, and invariants on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions

SCHEMA = "k int, commit_ts long, op string, v int"


def log_of(spark, rows):
    return spark.createDataFrame([(1, ts, op, None if op == "D" else ts) for ts, op in rows], SCHEMA)


def stamps(df):
    return sorted((r["commit_ts"] for r in df.collect()), reverse=True)


GOLDEN = [(12, "D"), *[(t, "U") for t in (10, 9, 8, 6, 3, 2)]]


@pytest.mark.parametrize(
    "ts,checkpoint,status,commit",
    [(1, 8, "ArchiveVersionMiss", 1), (2, 8, "Normal", 2), (7, 8, "Normal", 6), (15, 8, "Deleted", 12)],
)
def test_visible_with_archives(spark, ts, checkpoint, status, commit):
    got = versions.visible_status(log_of(spark, GOLDEN), ["k"], ts, checkpoint).collect()[0]
    assert (got["status"], got["commit_ts"]) == (status, commit)


@pytest.mark.parametrize("checkpoint,status", [(0, "VersionUnknown"), (3, "BaseVersionMiss"), (8, "ArchiveVersionMiss")])
def test_visible_miss(spark, checkpoint, status):
    assert versions.visible_status(log_of(spark, [(12, "D")]), ["k"], 5, checkpoint).collect()[0]["status"] == status


@pytest.mark.parametrize("oldest,kept", [(1, [10, 9, 8, 6, 3, 2]), (2, [10, 9, 8, 6, 3, 2]), (7, [10, 9, 8, 6]), (8, [10, 9, 8]), (15, [])])
def test_garbage(spark, oldest, kept):
    assert stamps(versions.collect_garbage(log_of(spark, GOLDEN), ["k"], oldest)) == [12, *kept]


def test_garbage_carries_over(spark):
    left = versions.collect_garbage(versions.collect_garbage(log_of(spark, GOLDEN), ["k"], 8), ["k"], 5)
    assert stamps(left) == [12, 10, 9, 8]


@pytest.mark.parametrize("oldest,kept", [(12, []), (9, [10, 9]), (8, [10, 9, 7]), (2, [10, 9, 7, 4, 3])])
def test_garbage_worked_example(spark, oldest, kept):
    assert stamps(versions.collect_garbage(log_of(spark, [(t, "U") for t in (12, 10, 9, 7, 4, 3)]), ["k"], oldest)) == [12, *kept]


@pytest.mark.parametrize(
    "all_,to,base,archive",
    [([12, 10, 9, 8, 7], 15, 12, [10, 9, 8, 7]), ([12, 10, 9, 8, 7], 11, 10, [9, 8, 7]), ([10, 8, 7, 5, 4], 9, 8, [7, 5, 4])],
)
def test_checkpoint(spark, all_, to, base, archive):
    got = versions.checkpoint(log_of(spark, [(t, "U") for t in all_]), ["k"], to).cache()
    assert stamps(got.where("target = 'base'")) == [base]
    assert stamps(got.where("target = 'archive'")) == archive


def test_add_archives(spark):
    have = log_of(spark, [])
    for more in ([6, 5, 3], [8], [2], [3, 2, 1], [5, 3, 1, 0]):
        have = versions.add_archives(have, log_of(spark, [(t, "U") for t in more]), ["k"])
    assert stamps(have) == [8, 6, 5, 3, 2, 1, 0]
    assert stamps(versions.add_archives(have, log_of(spark, [(1, "D")]), ["k"])) == [8, 6, 5, 3, 2, 1, 0]


def test_checkpoint_ts():
    assert versions.checkpoint_ts(5, 100, 20) == 80
    assert versions.checkpoint_ts(90, 100, 20) == 90
    assert versions.checkpoint_ts(150, 100, 20) == 100


def test_random_logs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(8), ts, rng.choice("UUD"), rng.randrange(100)) for ts in rng.sample(range(2, 400), 150)]
    log = spark.createDataFrame(rows, SCHEMA).cache()

    def visible(rows, t):
        best = {}
        for k, ts, op, v in rows:
            if ts <= t and ts > best.get(k, (0,))[0]:
                best[k] = (ts, op, v)
        return {k: (ts, v) for k, (ts, op, v) in best.items() if op != "D"}

    def got(df, t):
        return {r["k"]: (r["commit_ts"], r["v"]) for r in versions.as_of(df, ["k"], t).collect()}

    kept = versions.collect_garbage(log, ["k"], 200).cache()
    for t in (0, 50, 200, 260, 400):
        assert got(log, t) == visible(rows, t)
        if t >= 200:  # collecting garbage never changes what readers from its edge on see
            assert got(kept, t) == visible(rows, t)
    split = versions.checkpoint(log, ["k"], 300).cache()
    assert split.count() == sum(ts <= 300 for _, ts, _, _ in rows)
    assert got(split.drop("target"), 300) == visible(rows, 300)
    probes = spark.createDataFrame([(i, rng.randrange(9), rng.randrange(420)) for i in range(200)], "id int, k int, at long")
    for r in versions.as_of_join(probes, log, ["k"], "at", 40).collect():
        ts = max((ts for k, ts, _, _ in rows if k == r["k"] and ts <= r["at"]), default=None)
        assert r["seen_ts"] == ts
    assert versions.as_of_join(probes, log, ["k"], "at", 40).count() == 200
    assert versions.snapshot_conflicts(log, log.limit(0), ["k"], 5).count() == 0
    assert log.agg(F.count("k")).first()[0] == 150
