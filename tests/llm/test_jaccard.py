import collections
import random

import numpy as np
import pytest
from helpers import awkward, components, documents, shingles, words

from tidemark.llm import jaccard_join, queries


def copies(rng, n):
    """Texts of all sizes with copies at all distances, common passages, and a large group of near copies."""
    passages = [" ".join(words(rng, 50)) for _ in range(3)]
    base = words(rng, 120)
    out = []
    for i in range(n):
        w = words(rng, rng.choice([1, 2, 3, 4, 6, 9, 12, 18, 30, 90, 400]))
        if i % 3 == 0:
            w = list(base)
        elif i % 5 == 0:
            w += passages[i % len(passages)].split()
        elif out and i % 4 == 1:
            w = out[rng.randrange(len(out))].split() or w
        w = list(w)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(4000)}"
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,den,hot", [(4, 85, 100, False), (5, 8, 10, False), (4, 85, 100, True), (2, 1, 2, False)])
def test_join_matches_brute_force(spark, monkeypatch, k, num, den, hot):
    if hot:  # hot lists are dealt out in many ways
        monkeypatch.setattr(jaccard_join, "PART", 10)
    texts = copies(random.Random(k * num), 500)
    docs = documents(spark, list(enumerate(texts))).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, k, num, den).collect()}
    want = components(list(range(len(texts))), [shingles(t, k) for t in texts], num, den)
    assert got == dict(enumerate(want))


def test_query(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    want = components([r["doc_id"] for r in rows], [shingles(r["text"], 4) for r in rows], 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}


@pytest.mark.parametrize("num,den", [(85, 100), (8, 10), (1, 2)])
def test_lists_lose_no_link(num, den):
    """Linked sets share a list, whatever the boundary and the frequent n-grams are."""
    import numpy as np

    rng = np.random.default_rng(num)
    for small in (0, 9, 14):
        scheme = jaccard_join.Scheme(num, den, small)
        for n in [*range(1, 40), 80, 200]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            scheme.frequent = np.sort(a[: n // 2])
            for gone in range(n):
                for new in (0, gone, 2 * gone):
                    b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
                    if (n - gone) * den >= (n + new) * num and (gone or new):
                        assert np.intersect1d(scheme.lists(a), scheme.lists(b)).size, (n, gone, new, small)


def test_awkward_rows(spark):
    rows = [*awkward(), (20, "q r s t u v"), (20, "x y"), (21, "Q r s t u v ")]
    docs = documents(spark, rows)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect())
    assert len(got) == len(rows)
    assert ("21", 2, 20) in got and ("1", 0, 1) in got and ("6", 1, 4) in got and got.count(("4", 1, 4)) == 2
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_larger_sets_of_a_small_sets_list(spark):
    """Two sets that both link with a smaller one needn't link with each other, and don't where it is missing."""
    start = "a b c d e f g h i j"  # 7 n-grams of 4 words; with one more word 8, of which two such texts share 7
    texts = [f"{start} x", f"{start} y", "p q r s t u v w x y1", "p q r s t u v w x y1 z1", "p q r s t u v w x y1 z2"]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(documents(spark, list(enumerate(texts))), 4, 85, 100).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}


def test_keep_one(spark):
    docs = documents(spark, [*awkward(), (30, "a b c d e f g"), (31, "a b c d e f g")])
    kept = jaccard_join.keep_one(docs)
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert ids == sorted(["1", "2", "3", "None", "None", "4", "5", "7", "30"])
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_torn_group_sends_few_links(spark, monkeypatch):
    """In a large group of near copies around the threshold, no step passes on more rows than the group's lists have."""
    rng = random.Random(8)
    base = words(rng, 150)
    texts = []
    for _ in range(1500):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            w[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    seen = {}

    def watch(name, whole):
        def run(rows, *more):
            out = jaccard_join.common.materialise(whole(rows, *more))
            seen[name] = rows.count(), out.count()
            return out

        monkeypatch.setattr(jaccard_join, name, run)

    watch("open_nodes", jaccard_join.open_nodes)
    watch("links_within", jaccard_join.links_within)
    got = jaccard_join.join(documents(spark, list(enumerate(texts))).select("doc_id", "text"), 4, 85, 100).collect()
    want = components(list(range(len(texts))), [shingles(t, 4) for t in texts], 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == dict(enumerate(want))
    assert seen and all(after <= before for before, after in seen.values())


def test_keep_one_by_row(spark):
    """One id on unlike texts: each group keeps one row, whatever ids other groups share."""
    a, b = "a b c d e f g", "h i j k l m n"
    docs = documents(spark, [(1, a), (5, a), (5, b), (None, b), (5, b), (6, "x y z")])
    got = sorted((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect())
    assert got == [(1, a), (5, b), (6, "x y z")]


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_lists_of_two_are_one_row(spark, batch):
    """All nodes of longer and of hot lists, and both of a list of two in one row, however rows fall into batches."""
    rng = random.Random(1)
    posts = [(i, i % 50 + 1, [rng.randrange(60) if rng.random() < 0.3 else rng.randrange(60, 900) for _ in range(rng.randrange(8))]) for i in (rng.randrange(200) for _ in range(300))]
    want = collections.defaultdict(dict)
    for node, n, lists in posts:
        for at in lists:
            want[at][node] = n
    scheme = jaccard_join.Scheme(8, 10, hot=np.array([3, 70]), ways=np.array([2, 2]))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = jaccard_join.members(spark.createDataFrame(posts, "node long, n long, lists array<long>"), scheme).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    more, twos = collections.defaultdict(dict), {}
    for r in got:
        if r["other"] is None:
            more[r["at"]][r["node"]] = r["n"]
        else:
            twos[r["at"]] = {r["node"]: r["n"], r["other"]: r["other_n"]}
    assert more == {at: x for at, x in want.items() if len(x) > 2 or at in (3, 70)} and len(got) == sum(map(len, more.values())) + len(twos)
    assert twos == {at: x for at, x in want.items() if len(x) == 2 and at not in (3, 70)}
