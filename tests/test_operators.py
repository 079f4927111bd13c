"""Scans, writes, indexes, statistics, partitions, locks and feeds on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import feeds, indexes, locks, partitions, ranking, scan, statistics, writes


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_overlay_of_own_writes(spark):
    base = spark.createDataFrame([(v, v + 1000, 7) for v in range(100)], "k int, v int, version long")
    own = spark.createDataFrame([(5, "U", 5), (10, "U", 10), (7, "D", None), (200, "I", 1)], "k int, op string, v int")
    got = rows(scan.overlay(base, own, "k", low=3, low_inclusive=False), "k", "v", "version", "status")
    assert got[:4] == [(4, 1004, 7, "Normal"), (5, 5, 7, "Normal"), (6, 1006, 7, "Normal"), (7, None, 7, "Deleted")]
    assert got[6] == (10, 10, 7, "Normal") and got[-1] == (200, 1, 1, "Normal")
    back = rows(scan.overlay(base, own, "k", low=5, backward=True), "k", "v")
    assert back == [(5, 5), (4, 1004), (3, 1003), (2, 1002), (1, 1001), (0, 1000)]


def test_secondary_index_backward(spark):
    base = spark.createDataFrame([(v, chr(97 + v % 26), 1) for v in range(100)], "pk int, s string, commit_ts long")
    index = indexes.build(base, "pk", "s", ordered=True)
    got = rows(scan.scan(index, "sk", high="c0000", high_inclusive=False, backward=True), "sk", "pk")
    assert {s for s, _ in got} == {"a", "b", "c"} and got[0][0] == "c" and got[-1][0] == "a"
    assert indexes.lookup(index, base, "pk", "d", "d").count() == 4
    assert indexes.covering(index, "z").count() == 3


def test_patterns(spark):
    df = spark.createDataFrame([("user:1",), ("user:22",), ("use",), ("a.b",), ("aXb",), ("u*r",)], "k string")
    take = lambda p: sorted(r[0] for r in df.where(fn.matches(F.col("k"), p)).collect())
    assert take("user:*") == ["user:1", "user:22"]
    assert take("user:?") == ["user:1"]
    assert take("a.b") == ["a.b"] and take("a[!.]b") == ["aXb"] and take("u\\*r") == ["u*r"]
    assert len(take("")) == 6


@pytest.mark.parametrize(
    "ops,net", [("I", "I"), ("IU", "I"), ("IUD", "D"), ("U", "U"), ("UU", "U"), ("UD", "D"), ("D", "D"), ("UDI", "U"), ("IDI", "U"), ("DU", "X"), ("UI", "X"), ("II", "I")]
)
def test_write_composition(spark, ops, net):
    changes = spark.createDataFrame([("a", i, op, i) for i, op in enumerate(ops)], "k string, seq int, op string, v int")
    got = writes.compose(changes, ["k"], "seq").collect()[0]
    assert (got["op"], got["v"]) == (net, len(ops) - 1)
    if ops == "II":
        assert writes.compose(changes, ["k"], "seq", unique=True).collect()[0]["op"] == "E"


def test_commit_ts_and_validation(spark):
    w = spark.createDataFrame([(3, 10), (20, 4)], "last_validation_ts long, commit_ts long")
    r = spark.createDataFrame([(30,), (7,)], "version long")
    assert writes.commit_ts(1, 2, w, r).first()[0] == 31
    assert writes.commit_ts(1, 99, w).first()[0] == 99
    reads = spark.createDataFrame([("a", 5), ("b", 6), ("c", 0)], "k string, version long")
    now = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "k string, commit_ts long")
    assert rows(writes.invalid_reads(reads, now, ["k"], "version"), "k") == [("b",)]


def test_auto_increment(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10_000), 500)], "x int")
    got = sorted(rows(writes.auto_increment(df, "x", 10, 3), "x", "id"))
    assert [i for _, i in got] == [10 + 3 * i for i in range(500)]


def test_histogram(spark):
    one = statistics.steps(spark.range(100).select(F.col("id").alias("x")), "x")
    assert one.count() == 100
    many = sorted(rows(statistics.steps(spark.range(1000).select(F.col("id").alias("x")), "x"), "step", "x"))
    assert many == [(i, i * 7) for i in range(128)]
    few = spark.createDataFrame([(10,), (20,), (30,)], "x int")
    probes = spark.createDataFrame([(5,), (10,), (15,), (30,), (99,)], "p int")
    got = dict(rows(statistics.below(statistics.steps(few, "x"), probes, "x", "p"), "p", "selectivity"))
    assert got == {5: 0.125, 10: 0.25, 15: 0.375, 30: 0.75, 99: 0.875}
    none = statistics.range_rows(statistics.steps(few.limit(0), "x"), spark.createDataFrame([(1, 2)], "low int, high int"), "x", 1234)
    assert rows(none, "rows") == [(12,)]


def test_histogram_of_a_whole_table(spark, tmp_path):
    for n in (0, 1, 127, 128, 1025, 5000):
        keys = random.Random(n).sample(range(100_000), n)
        df = spark.createDataFrame([(x,) for x in [*keys, *keys[:50], None]], "x int").repartition(7)
        statistics.in_order(df, "x").write.parquet(f"{tmp_path}/{n}")
        ordered = spark.read.parquet(f"{tmp_path}/{n}")
        every = max(1, (n + 1) // 128)
        want = [*sorted(keys), None] if n < 128 else (sorted(keys) + [None])[::every][:128]
        got = [r["x"] for r in statistics.whole_steps(ordered, "x").collect()]
        assert sorted(got, key=lambda x: (x is None, x)) == want
    probes = spark.createDataFrame([(1,), (9,)], "p int")
    null_last = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert dict(rows(statistics.below(null_last, probes, "x", "p"), "p", "selectivity")) == {1: 0.25, 9: 0.625}


def test_random_pairing_is_uniform():
    hits = {k: 0 for k in range(40)}
    for seed in range(3000):
        pool = statistics.RandomPairing(8, seed)
        for k in range(30):
            pool.insert(k)
        for k in range(0, 10):
            pool.delete(k)
        for k in range(30, 40):
            pool.insert(k)
        assert len(pool.kept) <= 8 and set(pool.kept) == set(pool.place) and not set(pool.kept) & set(range(10))
        for k in pool.kept:
            hits[k] += 1
    share = [hits[k] / 3000 for k in range(10, 40)]
    assert max(share) < 1.25 * sum(share) / 30 and min(share) > 0.75 * sum(share) / 30


def test_ring_and_ranges(spark):
    nodes = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "position long, node_group int")
    got = dict(rows(partitions.ring_owner(spark.createDataFrame([(9,), (10,), (29,), (30,)], "bucket long"), nodes), "bucket", "owner"))
    assert got == {9: 0, 10: 1, 29: 2, 30: 0}
    ranges = spark.createDataFrame([(0, 1), (100, 2)], "start int, id int")
    assert rows(partitions.floor_lookup(spark.createDataFrame([(-1,), (0,), (99,), (100,)], "k int"), ranges, "k", "start"), "id") == [(None,), (1,), (1,), (2,)]


def test_split_plans(spark):
    slices = spark.createDataFrame([(i, 10) for i in range(100)], "slice int, bytes long")
    assert partitions.split_plan(slices, "slice", "bytes", 2000).count() == 1
    parts = rows(partitions.split_plan(slices, "slice", "bytes", 500).orderBy("part"), "start", "bytes")
    assert len(parts) == 20 and sum(b for _, b in parts) == 1000
    records = spark.createDataFrame([(1, i, 1000) for i in range(40)] + [(2, i, 100) for i in range(10)], "slice int, k int, n long")
    assert rows(partitions.slice_split_keys(records, "slice", "k", "n").orderBy("start"), "slice", "start") == [(1, 20)]


def test_average_size(spark):
    df = spark.createDataFrame([([10, 20, 30],)], "s array<int>")
    assert df.select(statistics.average_size(F.col("s"))).first()[0] == pytest.approx((10 * 0.9 + 2) * 0.9 + 3)


def test_deadlocks(spark):
    held = spark.createDataFrame(
        [(1, "a", "holding"), (1, "x", "holding"), (2, "a", "waiting"), (2, "b", "holding"), (1, "b", "waiting"), (3, "c", "holding"), (2, "c", "waiting"), (3, "a", "waiting")],
        "tx long, entry string, state string",
    )
    found = locks.cycles(locks.wait_for(held))
    assert sorted(rows(found, "cycle", "length")) == [([1, 2], 2), ([1, 2, 3], 3)]
    assert dict((tuple(c), v) for c, v in rows(locks.victims(found, held), "cycle", "victim")) == {(1, 2): 2, (1, 2, 3): 2}


def test_deadlocks_of_any_length(spark):
    """A ring of seven transactions with a chord: cycles of seven and of five."""
    held = [(i, f"e{i}", "holding") for i in range(7)] + [(i, f"e{(i + 1) % 7}", "waiting") for i in range(7)] + [(0, "e3", "waiting"), (3, "more", "holding"), (9, "e0", "waiting")]
    held = spark.createDataFrame(held, "tx long, entry string, state string")
    found = locks.cycles(locks.wait_for(held))
    assert sorted(rows(found, "cycle", "length")) == [([0, 1, 2, 3, 4, 5, 6], 7), ([0, 3, 4, 5, 6], 5)]
    assert {len(c): v for c, v in rows(locks.victims(found, held), "cycle", "victim")} == {7: 0, 5: 0}


def test_long_ring(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)] + [(40, 3), (5, 41), (41, 42)], "waiter long, holder long")
    assert rows(locks.cycles(ring), "cycle", "length") == [(list(range(30)), 30)]
    assert locks.trim(ring).count() == 30 and locks.cycles(ring.where("waiter > 30")).count() == 0


def test_ranks_without_one_window(spark):
    rng = random.Random(4)
    keys = [f"k{rng.randrange(10**6)}" for _ in range(700)]
    df = spark.createDataFrame([(k, i % 9 + 1) for i, k in enumerate(dict.fromkeys(keys))], "k string, n int").repartition(3)
    for backward in (False, True):
        got = sorted(rows(ranking.numbered(df, "k", backward=backward), "rn", "k"))
        assert [k for _, k in got] == sorted(set(keys), reverse=backward) and [n for n, _ in got] == list(range(1, len(set(keys)) + 1))
    sums = {r["k"]: (r["s"], r["s_all"]) for r in ranking.running(df, "k", s="n").collect()}
    total = 0
    for k, n in sorted(rows(df, "k", "n")):
        assert sums[k][0] == total
        total += n
    assert {x for _, x in sums.values()} == {total}
    assert rows(ranking.numbered(df.limit(0), "k"), "rn") == [] and rows(ranking.numbered(df.limit(1), "k"), "rn") == [(1,)]
    assert sorted(rows(writes.auto_increment(df, "k", 5, 2), "k", "id")) == [(k, 5 + 2 * i) for i, k in enumerate(sorted(set(keys)))]


@pytest.mark.parametrize("most", [65_536, 10])
def test_floor_lookup_both_ways(spark, most):
    starts = [(i * 7, f"r{i}") for i in range(3, 300)]
    keys = spark.createDataFrame([(x,) for x in [*range(0, 2300, 5), 21, 20, None]], "x int")
    got = rows(partitions.floor_lookup(keys, spark.createDataFrame(starts, "start int, name string"), "x", "start", most), "x", "start", "name")
    want = []
    for (x,) in rows(keys, "x"):
        held = [s for s in starts if x is not None and s[0] <= x]
        want.append((x, *(held[-1] if held else (None, None))))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_split_plan_of_many_ranges(spark):
    slices = spark.createDataFrame([(r, r * 100 + i, 50) for r in (1, 2) for i in range(20 if r == 1 else 3)], "r int, start int, n int")
    got = sorted(rows(partitions.split_plan(slices, "start", "n", 500, within="r"), "r", "part", "start", "slices"))
    assert [x for x in got if x[0] == 2] == [(2, 0, 200, 3)] and sum(x[3] for x in got if x[0] == 1) == 20 and len(got) == 21
    rewritten = partitions.rewrite_ranges(slices.where("r = 1"), "start", partitions.split_plan(slices.where("r = 1"), "start", "n", 500))
    assert len(set(rows(rewritten, "part"))) == 20


def test_point_read(spark):
    base = spark.createDataFrame([(1, 10, 3), (2, 20, 4)], "k int, v int, version long")
    own = spark.createDataFrame([(2, "D", None), (3, "I", 30), (1, "U", 11)], "k int, op string, v int")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "k int")
    assert sorted(rows(scan.point_read(base, own, wanted, "k"), "k", "version", "status", "v")) == [(1, 3, "Normal", 11), (2, 4, "Deleted", None), (3, 1, "Normal", 30), (4, 0, "Deleted", None)]
    assert sorted(rows(scan.point_read(base, own.limit(0), wanted, "k"), "k", "version", "v")) == [(1, 3, 10), (2, 4, 20), (3, 0, None), (4, 0, None)]


def test_write_set_look_ups(spark):
    own = spark.createDataFrame([(1, "U"), (2, "D")], "k int, op string")
    assert rows(writes.find_write(own, ["k"], k=2), "op") == [("D",)] and rows(writes.revert_write(own, ["k"], k=2), "k") == [(1,)]
    with pytest.raises(ValueError):
        writes.find_write(own, ["k"], other=2)


def test_commands_on_several_objects_and_expiry(spark):
    objects = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    commands = spark.createDataFrame([("x", [2, 1, 2]), ("y", [9])], "c string, wanted array<int>")
    got = dict(rows(feeds.multi_object(commands, objects, "c", "wanted", "k"), "c", "objects"))
    assert [o and o["v"] for o in got["x"]] == ["b", "a", "b"] and got["y"] == [None]
    c = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 20)], "k int, at int, ttl int")
    step = feeds.expiring(lambda state, row: f"{(state or '').split('@')[0]}{row['at']}@{row['ttl']}", lambda state: int(state.split("@")[1]), lambda row: row["at"] * 4)
    assert rows(feeds.fold_commands(c, "k", "at", "string", step), "state") == [("3@20",)]


def test_buckets_move_when_the_ring_grows(spark):
    buckets = spark.createDataFrame([(b,) for b in range(0, 4096, 8)], "bucket long")
    rings = [spark.createDataFrame(partitions.ring(n), "position long, node_group int") for n in (3, 4)]
    plan = partitions.migration(buckets, *rings)
    assert {r["target"] for r in plan.collect()} == {3} and 0 < plan.count() < 512
    assert spark.range(7, 8).select(partitions.range_bucket(F.col("id"))).first()[0] == 3285


def test_groups_merge(spark):
    counts = spark.createDataFrame([("t", 5), ("t", 7), ("u", 1)], "table_name string, records long")
    a, b = (spark.createDataFrame([(x,) for x in range(*r)], "k int") for r in ((0, 30), (20, 60)))
    whole, pool = statistics.merge_groups(counts, a, b, keys=["k"], size=16)
    assert dict(rows(whole, "table_name", "records")) == {"t": 12, "u": 1}
    assert sorted(rows(pool, "k")) == sorted(rows(statistics.bottom_sample(a.unionByName(b), "k", size=16), "k"))


def test_commands(spark):
    c = spark.createDataFrame([(1, 0, 1, False), (1, 1, 2, False), (1, 4, 5, False), (1, 0, 6, True), (1, 6, 7, False)], "k int, expected int, version int, ignores boolean")
    assert rows(feeds.applicable(c, "k", "expected", "version", "ignores"), "version") == [(1,), (2,), (6,), (7,)]
    assert sorted(rows(feeds.compact_commands(c.unionByName(c), "k", "version", "ignores"), "version")) == [(6,), (7,)]
    folded = feeds.fold_commands(c, "k", "version", "string", lambda state, row: (state or "") + str(row["version"]))
    assert rows(folded, "k", "state") == [(1, "12567")]


def test_replay_is_idempotent(spark):
    log = spark.createDataFrame([(1, 5, "U", 1), (2, 6, "D", None)], "k int, commit_ts long, op string, v int")
    more = spark.createDataFrame([(1, 5, "U", 9), (1, 7, "U", 2), (3, 2, "U", 3), (2, 1, "U", 0)], "k int, commit_ts long, op string, v int")
    once = feeds.replay(log, more, ["k"], schema_ts=3)
    assert sorted(once.collect()) == sorted(feeds.replay(once, more, ["k"], schema_ts=3).collect())
    assert sorted(rows(once, "k", "commit_ts", "v"))[0] == (1, 5, 1)
    newest = sorted(rows(feeds.replay(log, more, ["k"], schema_ts=3, multi_version=False), "k", "commit_ts"))
    assert newest == [(1, 7), (2, 6)]


def test_standby_and_publish(spark):
    sent = spark.createDataFrame([(0, 3), (0, 9), (1, 4), (7, 99)], "g int, seq long")
    start = spark.createDataFrame([(0, 4), (1, 4)], "g int, first_id long")
    marks = spark.createDataFrame([(0, 5), (0, 10)], "g int, mark long")
    assert sorted(rows(feeds.standby(sent, "g", "seq", marks, start), "g", "max_id", "consistent_mark")) == [(0, 9, 5), (1, 4, None)]
    assert feeds.publish(sent, spark.createDataFrame([("x",), ("y",)], "name string")).count() == 8


def test_lock_rules(spark):
    got = {tuple(r)[:4]: r["lock"] for r in writes.lock_matrix(spark).collect()}
    assert got[("Read", "Serializable", "OCC", False)] == "ReadIntent"
    assert got[("Read", "RepeatableRead", "Locking", False)] == "ReadLock"
    assert got[("ReadSkIndex", "ReadCommitted", "OCC", True)] == "NoLock"
    assert got[("ReadSkIndex", "ReadCommitted", "OCC", False)] == "ReadLock"
