import collections
import re

import pytest
from helpers import awkward, components, documents, shingles
from test_pii import base

import corpus_pipeline
from tidemark.llm import common, mixing, quality, queries, sentence_pieces

DATA = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = queries.table(spark, DATA, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near duplicates", "personal data", "mixing", "encoding"]
    kept = common.materialise(stages["quality classifier"](spark, docs, DATA))
    model = quality.fit(docs, queries.table(spark, DATA, "labels"))
    want = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    good = {r["doc_id"] for r in queries.table(spark, DATA, "labels").where("quality = 1").collect()}
    assert len(good & want) >= 0.99 * len(good)

    single = common.materialise(stages["near duplicates"](spark, kept, DATA))
    rows = kept.collect()
    found = components([r["doc_id"] for r in rows], [shingles(r["text"], 5) for r in rows], 8, 10)
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r, (_, c) in zip(rows, found, strict=True) if r["doc_id"] == c}

    clean = common.materialise(stages["personal data"](spark, single, DATA))
    assert clean.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert base(r["text"]) == "" or base(before[r["doc_id"]]) != base(r["text"])
        if not base(before[r["doc_id"]]) and not re.search("[0-9@]", before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])

    mixed = common.materialise(stages["mixing"](spark, clean, DATA))
    copies = mixing.plan(clean, whole=True).selectExpr("sum(size(shards)) AS n").first()["n"]
    assert mixed.columns == docs.columns and mixed.count() == copies

    out = stages["encoding"](spark, mixed, DATA)
    assert out.count() == copies and out.where("n_tokens = 0").count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "ids", "n_tokens", "log_prob", "inclusion"] and got.count() > 50


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and a column of every name that operators use inside."""
    near = "one two three four five six seven eight nine ten eleven twelve"
    return documents(spark, [*awkward(), (40, near), (41, near), (40, near), (42, f"{near} mail a@b.cc", "en", "s")]).persist()


def texts_of(frame):
    return collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got, given = stage(spark, odd, DATA), texts_of(odd)
    if name != "encoding":
        assert got.columns == odd.columns
    if name == "quality classifier":
        model = quality.fit(odd, queries.table(spark, DATA, "labels"))
        plain = {(i, t): model.score(__import__("numpy").array([quality.features((t or "").encode())]))[0] >= 0.5 for i, t in given}
        assert texts_of(got) == {k: n for k, n in given.items() if plain[k]}
    elif name == "near duplicates":
        kept = texts_of(got)
        assert not [k for k, n in kept.items() if k[1] and k[1].split() and n > 1]
        assert [i for i, t in kept if t and t.startswith("one two")] == [40] and sum(n for (i, t), n in kept.items() if not (t or "").split()) == sum(n for (i, t), n in given.items() if not (t or "").split())
    elif name == "personal data":
        assert texts_of(got) == collections.Counter({(i, t and t.replace("a@b.cc", "[EMAIL]")): n for (i, t), n in given.items()})
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())
    elif name == "mixing":
        want = collections.Counter()
        for r in mixing.plan(odd, whole=True).collect():
            want[r["doc_id"]] += len(r["shards"])
        assert collections.Counter(r["doc_id"] for r in got.collect()) == +want
    else:
        rows = got.collect()
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in odd.collect())
        assert all((r["n_tokens"] == 0) == (len(r["ids"]) == 0) for r in rows)


def test_stages_on_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), DATA).count() == 0


def test_encoding_decodes_what_it_returns(spark, monkeypatch):
    docs = documents(spark, [(1, "a\u2581b  c"), (2, "a b  c"), (3, "\u65e5\u672c \U0001f642\n"), (4, None)])
    got = {r["doc_id"]: r for r in corpus_pipeline.encoding_stage(spark, docs, DATA).collect()}
    model = sentence_pieces.read_model(queries.tokenizer_path("piece_bpe_32k.model"))
    plain = {r["doc_id"]: r["ids"] for r in sentence_pieces.encode(docs, model).collect()}
    assert {i: r["ids"] for i, r in got.items()} == plain
    monkeypatch.setattr(sentence_pieces, "decoded", lambda ids, vocabulary: "something else")
    with pytest.raises(Exception, match="don't decode to the text of document"):
        corpus_pipeline.encoding_stage(spark, docs, DATA).collect()


def test_encoding_holds_little_text_at_once(spark, monkeypatch):
    """Workers get few bytes a batch, whoever writes the stage's result, and encode about half a MB of them at a time."""
    docs = documents(spark, [(i, f"{i} hen " * 200) for i in range(1500)]).coalesce(1)
    sample = sentence_pieces.sample

    def bounded(texts, *more):
        assert sum(map(len, texts)) <= 1 << 19
        return sample(texts, *more)

    monkeypatch.setattr(sentence_pieces, "sample", bounded)
    got = corpus_pipeline.encoding_stage(spark, docs, DATA)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()  # it was written with materialise()'s limits
    assert got.count() == 1500 and got.where("n_tokens < 400").count() == 0
