import collections
import math
import random

import numpy as np
import pytest
from helpers import awkward, crc, documents, words
from pyspark.sql import functions as F

from tidemark.llm import common, lm_scoring, queries

DATA = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base_of(rows, learns):
    counts = collections.Counter()
    for i, t in rows:
        if learns(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in rows]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, DATA, "documents").collect()]
    got = {r["doc_id"]: r for r in queries.op9_lm_scoring(spark, DATA).collect()}
    for i, n, known, train, base in base_of(rows, lambda i: crc(i) % 5 != 1):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, crc(i) % 5 == 1)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.4])
def test_base_is_exact_for_any_share(spark, share):
    rows = [(i, t) for i, (_, t, *_) in enumerate(awkward())] + [(50, "a b a b c"), (51, "a b\nd A")]
    got = {r["doc_id"]: r for r in lm_scoring.score(documents(spark, rows), F.col("doc_id") != 51, share=share).collect()}
    for i, n, known, train, base in base_of(rows, lambda i: i != 51):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, train) and got[i]["base_score"] == pytest.approx(base)


def test_nothing_to_learn(spark):
    docs = documents(spark, awkward())
    got = lm_scoring.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score(docs.limit(0)).count() == 0


def plain_model(rows, learns, order=3, least=2, d=0.75):
    """Plain backoff model of all n-grams that occur `least` times: (probability of an n-gram's last word, training words)."""
    seen = [collections.Counter() for _ in range(order + 1)]
    for i, t in rows:
        x = tokens(t)
        for n in range(1, order + 1):
            if learns(i):
                seen[n].update(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    total, v = sum(seen[1].values()), len(seen[1])
    kept = [None, None, *({g: c for g, c in s.items() if c >= least} for s in seen[2:])]

    def p(g):
        if len(g) == 1:
            return (seen[1][g] + 0.5) / (total + 0.5 * (v + 1))
        h, after = g[:-1], [c for k, c in kept[len(g)].items() if k[:-1] == g[:-1]]
        fail = 1 - sum(c - d for c in after) / seen[len(h)][h] if after else 1
        arc = (kept[len(g)][g] - d) / seen[len(h)][h] if g in kept[len(g)] else 0
        return arc + fail * p(g[1:])

    return p, [g[0] for g in seen[1]]


def backoff(rows, learns, order=3):
    p, _ = plain_model(rows, learns, order)
    out = {}
    for i, t in rows:
        x = tokens(t)
        out[i] = sum(math.log10(p(tuple(x[max(0, k - order + 1) : k + 1]))) for k in range(len(x)))
    return out


SMALL = [(1, "a b a b a c d"), (2, "b A b e"), (3, ""), (4, "a b c d e a b"), (5, "x y z\u00e9 a b\tq"), (6, "x y z\u00e9 a b"), (7, None), (8, "never seen a b a")]


@pytest.mark.parametrize("share", [1e-6, 0.08, 1.0])
@pytest.mark.parametrize("order,hot", [(1, 500_000), (2, 2), (3, 500_000), (3, 2), (4, 3)])
def test_scores_of_all_repeated_ngrams(spark, monkeypatch, order, hot, share):
    """hot: histories that occur so often are counted in several groups; share: which words travel with the plan."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, SMALL), F.col("doc_id") != 8, share=share, order=order).collect()}
    assert got == pytest.approx(backoff(SMALL, lambda i: i != 8, order))


def test_probabilities_sum_to_one():
    p, words = plain_model(SMALL, lambda i: True)
    for history in [(), (b"a",), (b"a", b"b"), (b"nowhere",), (b"b", b"a")]:
        assert sum(p((*history, w)) for w in [*words, b"unseen"]) == pytest.approx(1)


def test_seldom_ngrams_count_in_a_large_corpus(spark):
    """Twice in a million and a half tokens is far below the shares that were once kept."""
    filler = [(i, "w " * 50_000) for i in range(30)]
    rows = [*filler, (100, "rare phrase here"), (101, "rare phrase here"), (102, "phrase rare here")]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, rows)).collect() if r["doc_id"] >= 100}
    assert got[100] > got[102] + 5


def test_order_stays_with_many_words(spark):
    """Six places among 1500 words don't fit a 62-bit number by powers of the vocabulary."""
    many = " ".join(f"w{k}" for k in range(1500))
    rows = [(i, t) for i, t in enumerate([many, many, "x a b c d t", "x a b c d t", "y a b c d u", "y a b c d u"])]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, rows), order=6).collect()}
    assert {i: got[i] for i in range(2, 6)} == pytest.approx({i: x for i, x in backoff(rows[:], lambda i: True, 6).items() if i > 1})


def test_states_stand_once_and_in_order(spark):
    """All parts of a key are added up before texts ask for it, which they do several times."""
    docs = documents(spark, SMALL)
    with common.scratch(spark):
        rows = lm_scoring.Model(docs.select("text"), 1.0, 2, 3, 0.75).entries.collect()
    assert rows and len({r["bucket"] for r in rows}) == len(rows)
    for r in rows:
        keys = np.frombuffer(r["key"], np.uint64)
        assert (keys[1:] > keys[:-1]).all() and len(r["more"]) == len(r["base"]) == len(r["key"])


def test_texts_hash_alike_in_any_company(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(300))).encode() for _ in range(60)] + [b"", b" \t", b"Ab aB ab", b"x" * 9000, " é\x00 ".encode()]
    alone = [lm_scoring.hashed([t])[0].tolist() for t in texts]
    monkeypatch.setattr(lm_scoring, "HASH_BYTES", 1000)  # several parts, and texts longer than one
    keys, sizes = lm_scoring.hashed(texts)
    assert keys.tolist() == sum(alone, []) and sizes.tolist() == [len(x) for x in alone] == [len(t.split()) + 1 for t in texts]
    assert len(set(alone[-3][:3])) == 1
