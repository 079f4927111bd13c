"""Stored tables and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.sources import ConflictError, Table


def values(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v int, op string")


@pytest.fixture
def table(spark, tmp_path):
    return Table.create(spark, f"{tmp_path}/t", "k int, v int", ["k"])


def test_time_travel(spark, table):
    a = table.commit(changes(spark, (1, 1, "I"), (2, 2, "I")))
    b = table.commit(changes(spark, (1, 10, "U"), (2, None, "D")))
    assert values(table.snapshot()) == [(1, 10)]
    assert values(table.snapshot(a)) == [(1, 1), (2, 2)]
    assert b == a + 1
    table.checkpoint()
    assert values(table.snapshot()) == [(1, 10)]
    assert table.log().where("op = 'D'").isEmpty()


def test_checkpoint_keeps_what_readers_see(spark, table):
    a = table.commit(changes(spark, (1, 1, "I"), (2, 2, "I")))
    table.commit(changes(spark, (1, 10, "U"), (2, None, "D")))
    table.checkpoint(oldest_active=a)
    assert values(table.snapshot(a)) == [(1, 1), (2, 2)] and values(table.snapshot()) == [(1, 10)]


def test_first_committer_wins(spark, table):
    table.commit(changes(spark, (1, 1, "I")))
    seen = table.version()
    table.commit(changes(spark, (1, 2, "U")))
    with pytest.raises(ConflictError):
        table.commit(changes(spark, (1, 3, "U")), read_version=seen)
    table.commit(changes(spark, (5, 5, "I")), read_version=seen)  # another row: goes on top
    with pytest.raises(ConflictError):
        table.commit(changes(spark, (6, 6, "I")), read_version=seen, reads=changes(spark, (1, 0, "U")))
    with pytest.raises(ConflictError):
        table.commit(changes(spark, (5, 6, "I")), unique=True)
    assert values(table.snapshot()) == [(1, 2), (5, 5)]


def test_definition(spark, table, tmp_path):
    table.commit(changes(spark, (1, 7, "I"), (2, 7, "I")))
    table.alter_indexes(add={"by_v": "v"})
    assert sorted(r["pk"] for r in table.index("by_v").collect()) == [1, 2]
    assert table.analyze()["records"] == 2
    assert Table.discover(spark, str(tmp_path)) == ["t"]
    table.truncate()
    assert table.snapshot().isEmpty()
    table.drop()
    assert Table.discover(spark, str(tmp_path)) == []
    with pytest.raises(FileNotFoundError):
        table.snapshot()


def entries(df):
    return sorted((r["sk"], r["pk"]) for r in df.collect())


def test_indexes_stay_current(spark, table, tmp_path):
    table.commit(changes(spark, (1, 7, "I"), (2, 8, "I"), (3, None, "I")))
    table.commit(changes(spark, (1, 9, "U"), (2, None, "D")))
    table.alter_indexes(add={"by_v": "v"})  # from the snapshot, not from older versions
    assert entries(table.index("by_v")) == [(9, 1)]
    b = table.commit(changes(spark, (3, 5, "U"), (4, 9, "I"), (1, 9, "U")))
    assert entries(table.index("by_v")) == [(5, 3), (9, 1), (9, 4)]
    table.commit(changes(spark, (3, 6, "U"), (4, None, "D")))
    assert entries(table.index("by_v")) == [(6, 3), (9, 1)] and entries(table.index("by_v", b)) == [(5, 3), (9, 1), (9, 4)]
    table.checkpoint()
    copy = table.backup(f"{tmp_path}/copy")
    assert entries(table.index("by_v")) == entries(copy.index("by_v")) == [(6, 3), (9, 1)]


def test_unique_index(spark, table):
    table.commit(changes(spark, (1, 7, "I"), (2, 7, "I")))
    with pytest.raises(ConflictError):
        table.alter_indexes(add={"by_v": "v"}, unique=["by_v"])
    table.commit(changes(spark, (2, 8, "U")))
    table.alter_indexes(add={"by_v": "v"}, unique=["by_v"])
    for bad in ((3, 8, "I"), (1, 8, "U")):
        with pytest.raises(ConflictError):
            table.commit(changes(spark, bad))
    table.commit(changes(spark, (1, 8, "U"), (2, 7, "U")))  # they change places
    assert entries(table.index("by_v")) == [(7, 2), (8, 1)]


def test_index_of_composite_keys(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t2", "a int, b int, v string", ["a", "b"], {"by_v": "v"})
    t.commit(spark.createDataFrame([(1, 1, "x", "I"), (1, 2, "x", "I")], "a int, b int, v string, op string"))
    t.commit(spark.createDataFrame([(1, 1, "y", "U")], "a int, b int, v string, op string"))
    assert sorted((r["sk"], r["pk"]["a"], r["pk"]["b"]) for r in t.index("by_v").collect()) == [("x", 1, 2), ("y", 1, 1)]


def test_more_columns(spark, table):
    table.commit(changes(spark, (1, 7, "I")))
    seen = table.version()
    table.add_columns("w string")
    with pytest.raises(ConflictError):
        table.commit(changes(spark, (2, 7, "I")), read_version=seen)
    table.commit(spark.createDataFrame([(2, 8, "new", "I")], "k int, v int, w string, op string"))
    assert sorted((r["k"], r["w"]) for r in table.snapshot().collect()) == [(1, None), (2, "new")]


def test_statistics_are_read_back(spark, table):
    table.commit(spark.range(100).selectExpr("CAST(id AS int) AS k", "1 AS v", "'I' AS op"))
    assert Table.refresh_statistics([table]) == [table.path] and Table.refresh_statistics([table]) == []
    facts, sample = table.statistics()
    assert facts["records"] == 100 and not facts["stale"] and sample.count() == 100
    assert [r["rows"] for r in table.estimate(spark.createDataFrame([(0, 50)], "low int, high int")).collect()] == [49]
    table.commit(spark.range(100, 120).selectExpr("CAST(id AS int) AS k", "1 AS v", "'I' AS op"))
    assert table.statistics()[0]["stale"]
    table.drop_statistics()
    with pytest.raises(LookupError):
        table.statistics()


def test_steps_come_from_all_keys(spark, table):
    ranges = spark.createDataFrame([(0, 230), (-5, 9999), (1, 5)], "low int, high int")
    table.analyze()
    assert [(r["selectivity"], r["rows"]) for r in table.estimate(ranges).collect()] == [(0.0, 0)] * 3
    table.commit(spark.range(3000).selectExpr("CAST(id * 7 % 3000 AS int) AS k", "1 AS v", "'I' AS op"))
    table.analyze()
    table.vacuum()
    got = {r["low"]: (r["selectivity"], r["rows"]) for r in table.estimate(ranges).collect()}
    assert got == {0: (pytest.approx(10 / 129), 232), -5: (pytest.approx(128 / 129), 2976), 1: (0.0, 0)}


def test_statistics_of_composite_keys(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t3", "v string, step int, b int", ["step", "b"])
    t.commit(spark.range(4000).selectExpr("'x' AS v", "CAST(id % 300 AS int) AS step", "CAST(id AS int) AS b", "'I' AS op"))
    assert t.analyze()["records"] == 4000 and t.statistics()[1].count() == 1024
    assert t.estimate(spark.createDataFrame([(2, 100)], "low int, high int")).first()["selectivity"] == pytest.approx(49 / 129)


def test_stream_keeps_a_sample(spark, tmp_path):
    schema = "pool string, k int, op string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    sample = streaming.sampled(streaming.change_feed(spark, f"{tmp_path}/in", schema, 1), "pool", "k", 10)
    for rows in ([("a", i, "U") for i in range(40)] + [("b", 1, "U")], [("a", i, "D") for i in range(20)], [("a", i, "U") for i in range(40, 60)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = sample.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out"))
        query.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    (got,) = [r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["pool"] == "a"]
    assert got["records"] == 40 and len(got["sample"]) <= 10 and all(20 <= k < 60 for k in got["sample"])


def test_stream_replay(spark, table, tmp_path):
    feed = spark.createDataFrame([(1, 1, 5, "U"), (2, 2, 6, "U"), (1, 3, 8, "U")], "k int, v int, commit_ts long, op string")
    feed.write.parquet(f"{tmp_path}/feed")
    stream = streaming.change_feed(spark, f"{tmp_path}/feed", "k int, v int, commit_ts long, op string")
    for _ in range(2):
        streaming.replay_into(stream, table, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert values(table.snapshot()) == [(1, 3), (2, 2)] and table.log().count() == 3


def test_stream_commands_wait_for_gaps(spark, tmp_path):
    schema = "k int, obj_version int, new_version int, item string"
    batches = [[(1, 1, 2, "b"), (2, 0, 1, "x")], [(1, 0, 1, "a")], [(1, 3, 4, "d"), (1, 0, 1, "a")], [(1, 2, 3, "c")]]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = streaming.change_feed(spark, f"{tmp_path}/in", schema, 1)
    folded = streaming.fold_stream(stream, "k", "new_version", "string", lambda state, c: (state or "") + c["item"])
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = folded.writeStream.outputMode("update").foreachBatch(lambda b, n, i=i: b.withColumn("step", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out"))
        query.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["k"], r["step"]): (r["version"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[(1, 0)] == (0, None) and got[(1, 1)] == (2, "ab") and got[(1, 3)] == (4, "abcd") and got[(2, 0)] == (1, "x")


def test_backup_and_vacuum(spark, table, tmp_path):
    a = table.commit(changes(spark, (1, 1, "I"), (2, 2, "I")))
    copy = table.backup(f"{tmp_path}/copy")
    table.commit(changes(spark, (1, 5, "U")))
    assert values(copy.snapshot()) == [(1, 1), (2, 2)]
    assert values(copy.snapshot(a)) == [(1, 1), (2, 2)]
    table.checkpoint()
    assert table.vacuum() > 0
    assert values(table.snapshot()) == [(1, 5), (2, 2)]


def test_manifest_is_plain_json(table):
    assert json.loads(json.dumps(table.manifest()))["keys"] == ["k"]
