import collections
import math
import random

import pytest
from helpers import awkward, documents, words
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries

DATA = "/root/testdata/sf0.001"


def goals(sizes):
    """Targets by raising and resharing until none is above three times its source's size."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, full, rest, open_ = sum(sizes.values()), set(), 0, 1
    while True:
        rest = total - sum(3 * sizes[k] for k in full)
        open_ = sum(weight[k] for k in names if k not in full)
        new = {k for k in names if k not in full and rest * weight[k] / open_ > 3 * sizes[k]}
        if not new:
            return {k: 3 * sizes[k] if k in full else rest * weight[k] / open_ for k in names}
        full |= new


def check(spark, rows):
    got = mixing.plan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    sizes, source = collections.Counter(), {}
    for i, t, *rest in rows:
        src = ([*rest, None, None])[1]
        sizes[src] += size(t)
        source[i] = src
    want, taken = goals(dict(sizes)), collections.Counter()
    for r in got:
        src = source[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[src]) and r["source_size"] == sizes[src]
        assert len(r["shards"]) == math.ceil(r["taken"] / r["size"]) if r["size"] else r["taken"] == 0
        taken[src] += r["taken"]
    for src, t in want.items():
        assert abs(taken[src] - t) <= 1
    assert sorted(map(str, mixing.plan(documents(spark, rows[::-1])).collect())) == sorted(map(str, got))


def test_targets_and_quotas(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 80, 300]))), None, rng.choice(["a", "b", "b", "B", "é", None])) for i in range(300)]
    check(spark, rows)


def test_one_source_may_be_large(spark):
    rows = [(i, "x y z", None, "big" if i % 3 else f"s{i % 5}") for i in range(400)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(awkward())]
    check(spark, rows)
    assert mixing.plan(documents(spark, rows).limit(0)).count() == 0
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0
    assert mixing.plan(documents(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_tree_splits_exactly_and_by_its_law(spark):
    quotas = spark.createDataFrame([("a", 60), ("b", 30), ("c", 7), (None, 3)], "source string, quota long")
    draws = []
    for seed in range(12):
        got = mixing.shard_quotas(quotas, 3, seed).collect()
        per = collections.Counter()
        for r in got:
            per[r["source"]] += r["quota"]
        assert per == {"a": 60, "b": 30, "c": 7, None: 3}
        shards = collections.Counter()
        for r in got:
            shards[r["shard"]] += r["quota"]
        assert set(shards.values()) <= {12, 13}
        draws += [r["quota"] for r in got if r["source"] == "a"]
    mean = sum(draws) / len(draws)
    spread = sum((x - mean) ** 2 for x in draws) / len(draws)
    assert mean == 7.5 and 1.4 < spread < 4.5  # hypergeometric: 12.5 * 0.6 * 0.4 * 87.5 / 99 = 2.65


def test_draw_is_hypergeometric(spark):
    n, own, left, many = 20, 8, 6, 20_000
    u = (F.col("id") + 0.5) / many
    got = collections.Counter(r[0] for r in spark.range(many).select(mixing.draw(F.lit(n).cast("long"), F.lit(own).cast("long"), F.lit(left).cast("long"), u)).collect())
    for k in range(7):
        p = math.comb(own, k) * math.comb(n - own, left - k) / math.comb(n, left)
        assert abs(got[k] / many - p) < 1e-3


def test_mixed_rows(spark):
    docs = queries.table(spark, DATA, "documents")
    plan = {r["doc_id"]: r for r in mixing.plan(docs, whole=True).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert {k: copies[k] for k in plan} == {k: len(r["shards"]) for k, r in plan.items()}
    clash = documents(spark, awkward())
    assert mixing.mix(clash).columns == clash.columns


def test_repeated_rows_across_the_cut(spark):
    """Rows alike are taken as often as planned, wherever the cut lies, with null ids and other columns that differ."""
    docs = [(None if i % 2 else 7, "x y z", None, "big") for i in range(600)] + [(i, "p q", None, "small") for i in range(50)]
    frame = documents(spark, docs).withColumn("extra", F.monotonically_increasing_id()).repartition(5)
    want = collections.Counter()
    for r in mixing.plan(frame, whole=True).collect():
        want[r["doc_id"]] += len(r["shards"])
    got = mixing.mix(frame)
    assert got.columns == frame.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == +want
    assert max(collections.Counter(r["extra"] for r in got.collect()).values()) <= 3
    assert 0 < want[7] != 600 or 0 < want[None] != 600
    assert collections.Counter(r["doc_id"] for r in mixing.mix(frame).collect()) == +want


def test_texts_move_once(spark):
    """Texts are dealt to shards, and not joined row by row before."""
    docs = documents(spark, [(i, "a b " * (i % 9), "en", "pqr"[i % 3]) for i in range(400)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mixing.mix(docs)
        steps = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" not in steps and steps.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in steps
    want = collections.Counter()
    for r in mixing.plan(docs, whole=True).collect():
        want[r["doc_id"]] += len(r["shards"])
    assert collections.Counter(r["doc_id"] for r in got.collect()) == +want
