import collections
import itertools
import math
import tracemalloc

import numpy as np
import pytest
from helpers import awkward, documents

from tidemark.llm import queries, sentence_pieces

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.read_model(queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary(model):
    return sentence_pieces.Vocabulary(model, 0.5)


def all_paths(text, v):
    """Every segmentation of a text of letters that have pieces, with its share."""
    index = {p: i for i, p in enumerate(v.pieces)}
    text, out = "▁" + text.replace(" ", "▁"), {}
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, begin = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[begin:i])
                begin = i
        parts.append(text[begin:])
        if all(p in index for p in parts):
            out[tuple(index[p] for p in parts)] = sum(v.weight[index[p]] for p in parts)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: x - total for k, x in out.items()}


def test_samples_follow_the_lattice(vocabulary):
    want = all_paths("the hen", vocabulary)
    n = 30_000
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, n)
    found = sentence_pieces.sample(["the hen"] * n, keys, vocabulary, 3)
    pairs, weights = collections.Counter(), []
    for samples in found:
        names = [tuple(ids.tolist()) for ids, _, _ in samples]
        assert len(set(names)) == 3
        assert all(abs(want[p] - phi) < 1e-9 for p, (_, phi, _) in zip(names, samples, strict=True))
        pairs[names[0], names[1]] += 1
        weights.append(sum(math.exp(phi - inclusion) for _, phi, inclusion in samples))
    chi, cells = 0.0, 0
    for (a, b), c in pairs.items():
        e = n * math.exp(want[a] + want[b]) / (1 - math.exp(want[a]))
        if e > 20:
            chi, cells = chi + (c - e) ** 2 / e, cells + 1
    assert chi < cells + 5 * math.sqrt(2 * cells)
    assert abs(np.mean(weights) - 1) < 0.01  # shares over inclusion probabilities add up to 1 on average


def test_few_segmentations(vocabulary):
    (found,) = sentence_pieces.sample(["b"], np.array([7]), vocabulary, 9)
    assert {tuple(i.tolist()) for i, _, _ in found} == set(all_paths("b", vocabulary)) and all(x[2] == 0 for x in found)


def test_long_words_sum_alike(vocabulary):
    long = "ab" * 150
    lattice = sentence_pieces.Lattice(["▁" + long, "▁ab"], vocabulary)
    for node in range(1, 40):
        shares = np.exp(lattice.log_q[lattice.arcs[node] : lattice.arcs[node + 1]])
        assert shares.sum() == pytest.approx(1)


def test_round_trip(spark, model):
    rows = [*awkward(), (8, "  Hello  world\n\nfoo\tbar "), (9, "日本語 🙂👍🏽 नमस्ते"), (10, "a" * 3000), (11, "\x00\x7f\r\n"), (12, " ")]
    docs = documents(spark, rows)
    got = sentence_pieces.decode(sentence_pieces.encode(docs, model, k=3, check=3), model).collect()
    texts = collections.defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t or "")
    for r in got:
        assert r["round_trip"] and r["text"] in texts[r["doc_id"]]
    assert sum(r["sample"] == 1 for r in got) == len(rows)
    assert sentence_pieces.encode(docs.limit(0), model).count() == 0


def test_reruns_and_batches_agree(spark, model):
    docs = queries.table(spark, DATA, "documents").limit(60)
    a = sentence_pieces.encode(docs, model, k=2).collect()
    b = sentence_pieces.encode(docs.repartition(7), model, k=2).collect()
    assert {(r["doc_id"], r["sample"]): r["ids"] for r in a} == {(r["doc_id"], r["sample"]): r["ids"] for r in b}


def test_query(spark):
    got = queries.op3_sentence_pieces(spark, DATA).collect()
    assert len({r["doc_id"] for r in got}) == 200 and all(r["round_trip"] for r in got if r["sample"] == 1)


def test_models_of_one_size_are_told_apart(spark, model):
    """A worker that has met one model decodes another of the same size by its own pieces."""
    other = {**model, "pieces": [*model["pieces"][:300], *model["pieces"][:299:-1]]}
    ids = spark.createDataFrame([([400, 500],)], "ids array<int>").coalesce(1)
    first, second = (sentence_pieces.decode(ids, m).first()["text"] for m in (model, other))
    want = ["".join(m["pieces"][i] for i in (400, 500)).replace("\u2581", " ").removeprefix(" ") for m in (model, other)]
    assert [first, second] == want and first != second


def test_query_decodes_every_sample(spark):
    got = queries.op3_sentence_pieces(spark, DATA).select("sample", "round_trip").collect()
    assert {r["sample"] for r in got} == {1, 2} and all(r["round_trip"] for r in got)


def test_first_letters_need_no_search(model, monkeypatch):
    """Of each letter, the first step through the pieces is looked up by its place, and only further ones in the hashed table."""
    v, asked, move = sentence_pieces.Vocabulary(model, 1.0), [], sentence_pieces.Vocabulary.move
    monkeypatch.setattr(sentence_pieces.Vocabulary, "move", lambda self, states, letters: asked.extend(states.tolist()) or move(self, states, letters))
    text = "the hen 🙂 naïve ☃  日本語\x00"
    ((found, *_),) = sentence_pieces.sample([text], np.array([3]), v, 1)
    assert asked and 0 not in asked and sentence_pieces.decoded(found[0], v) == text


def test_lattices_of_parts_are_not_held_twice(vocabulary, monkeypatch):
    """While parts are put together they are narrow and let go, so the peak is not twice what stays."""
    rng = np.random.default_rng(5)
    words = ["▁" + "".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(60_000)]
    monkeypatch.setattr(sentence_pieces, "PART", 1 << 14)
    tracemalloc.start()
    try:
        lattice = sentence_pieces.Lattice(words, vocabulary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.8 * sum(x.nbytes for x in vars(lattice).values())


def test_small_blocks_and_parts_change_no_row(spark, model, monkeypatch):
    docs = queries.table(spark, DATA, "documents").limit(60)
    a = sentence_pieces.encode(docs, model, k=2, check=2).collect()
    monkeypatch.setattr(sentence_pieces, "PART", 1 << 9)
    b = sentence_pieces.encode(docs, model, k=2, check=2, block=1 << 12).collect()
    assert sorted(a, key=lambda r: (r["doc_id"], r["sample"])) == sorted(b, key=lambda r: (r["doc_id"], r["sample"]))
