import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, lattice_dedup, permutation_ann, queries

DATA = "/root/testdata/sf0.01"
ODD = [
    (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None),
    (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.01], 1), (12, [float("inf"), 0.0], 1), (13, [-1.0, 0.0], 1),
]
SCHEMA = "vec_id long, embedding array<float>, label int"


def links(rows, threshold=0.93):
    """(links, smallest linked id) per id, from all pairs."""
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(near, root[None, :], root.max()).min(axis=1))
        if (low == root).all():
            return {int(i): (int(n), int(r)) for i, n, r in zip(ids, near.sum(axis=1), root, strict=True)}
        root = low


def clustered(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(1500):
        v = rng.normal(size=16)
        if i % 3 == 0:  # a third near one direction, many of them equal
            v = np.ones(16) + rng.normal(size=16) * (0 if i % 2 else 0.35)
        rows.append((i, [float(z) for z in v], i % 2 if i % 3 else 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("small_parts", [False, True])
def test_links_match_brute_force(spark, monkeypatch, small_parts):
    if small_parts:  # cells are cut into tiles
        monkeypatch.setattr(lattice_dedup, "PART", 64)
    vectors = clustered(spark)
    want = links(vectors.collect())
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice_dedup.near_duplicates(vectors).collect()}
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert true > 10_000 and 0.99 * true <= found <= true
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.99


def test_query_finds_all_links(spark):
    want = links(queries.table(spark, DATA, "embeddings").collect())
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op5_near_dedup(spark, DATA).collect()}
    assert got == want


def test_odd_vectors(spark):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.near_duplicates(spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert got[1] == (3, 1, True) and got[11] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12, 13)) and got[None] == (0, None, False)
    assert lattice_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("rep", "m", "dim", "cell", "t", "_use")})
    assert lattice_dedup.near_duplicates(extra).count() == len(ODD)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, size=(300, 8))
    p = lattice_dedup.lattice_point(x)
    near = lattice_dedup.shortest_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    own = ((x - p) ** 2).sum(axis=1)
    assert (own[:, None] <= ((x[:, None, :] - p[:, None, :] - near) ** 2).sum(axis=2) + 1e-9).all()


def nearest(rows, query, k=5):
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows}
    q = x[query]
    scores = sorted((-(v @ q) / np.sqrt((v @ v) * (q @ q)), i) for i, v in x.items() if i != query)
    return [i for _, i in scores[:k]]


@pytest.mark.parametrize("source", ["table", "clustered"])
def test_recall(spark, source):
    vectors = clustered(spark, 2) if source == "clustered" else queries.table(spark, DATA, "embeddings")
    rows = vectors.collect()
    got = {}
    for r in permutation_ann.Index(vectors).search(vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = [len(set(nearest(rows, q)) & set(v)) / 5 for q, v in got.items()]
    assert len(got) == len([r for r in rows if r["vec_id"] % 20 == 0]) and np.mean(hits) >= 0.9


def test_small_tables_and_ties(spark):
    odd = spark.createDataFrame([(i, v) for i, v, _ in ODD] + [(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = permutation_ann.Index(odd).search(odd.where("vec_id IN (1, 4, 5, 9, 11)")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got if r["query_id"] == 1] == [(1, 2), (1, 3), (1, 8), (1, 11), (1, 13)]
    assert {r["query_id"] for r in got} == {1, 11}  # the others are no vectors, or alone in their length
    assert permutation_ann.Index(odd.limit(0)).search(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 300)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(900):
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert got == {k: v for k, v in root.items() if k in got} and all(a in got for a, b in edges if a != b)
