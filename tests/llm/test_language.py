import collections
import math
import unicodedata

import numpy as np
import pytest
from helpers import awkward, crc, documents

from tidemark.llm import language_id, queries

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in queries.table(spark, DATA, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, DATA).collect()}
    assert len(got) == len(truth) and all(r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert np.mean([got[i]["lang_pred"] == x for i, x in truth.items() if crc(i) % 5 == 0]) > 0.98


def test_sums_match_plain_counts():
    """Scores of texts in blocks are those of whole texts, counted letter by letter."""
    table = language_id.letter_table()
    text = "Hello, wörld! Ünd 12 x"
    found = language_id.grams(language_id.code_points([text], table)[0])
    plain = "".join(c.lower() if c.isalpha() else " " for c in " " + text)
    for n, bucket in zip(language_id.ORDERS, found, strict=True):
        assert (bucket >= 0).sum() == sum(plain[i] != " " and i >= n - 1 and all(plain[j] != " " for j in range(i - n + 2, i)) for i in range(len(plain)))


def plain_bayes(train, texts):
    """Naive Bayes over the same buckets, gram by gram: (language or und, score) of each text."""
    size = language_id.BUCKETS

    def letters(text):
        kept = [(c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text or ""]
        return " " + "".join(kept)

    def grams(text):
        x = letters(text)
        for n in language_id.ORDERS:
            for i in range(n - 1, len(x)):
                if x[i] != " " and " " not in x[i - n + 2 : i]:
                    key = 0
                    for back in range(n - 1, -1, -1):  # shorter grams' terms are part of a longer one's
                        code = ord(x[i - back]) + (language_id.MARK if unicodedata.category(x[i - back])[0] == "M" else 0)
                        key += code * (0x9E3779B97F4A7C15 * (2 * (back + 1) + 1) % (1 << 64))
                    yield (((key * 0xD6E8FEB86659FD93) + n) % (1 << 64)) >> 48

    counts = collections.defaultdict(collections.Counter)
    for text, lang in train:
        counts[lang].update(grams(text))
    out = []
    for text in texts:
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append(("und", 0.0))
            continue
        found, n = list(grams(text)), sum(c != " " for c in letters(text))
        logs = {k: sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * size)) for g in found) / math.sqrt(n) for k, c in counts.items()}
        top = max(logs.values())
        best = min(k for k in logs if logs[k] == top)
        out.append((best, 1 / sum(math.exp(v - top) for v in logs.values())))
    return out


def test_predictions_match_plain_bayes(spark):
    train = [("the cat and the dog", "en"), ("a dog sat there, Then", "en"), ("le chat et le chien", "fr"), ("où est l'e\u0301te\u0301", "fr"), ("der Hund und die Katze", "de"), ("x", None)]
    texts = ["the chat", "un chien là", "die Hunde", "\u0301", "\u20dd\u064b", "e\u0301", "zzz qqq", "", None, "12 34", "Dog! dog."]
    docs = documents(spark, [(i, t, x) for i, (t, x) in enumerate(train)])
    asked = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(asked, *language_id.fit(docs)).collect()}
    want = plain_bayes([(t, x) for t, x in train if x], texts)
    assert [got[i][0] for i in range(len(texts))] == [x for x, _ in want]
    assert [got[i][1] for i in range(len(texts))] == pytest.approx([s for _, s in want], rel=1e-3)


def test_many_languages_are_bounded(spark):
    docs = documents(spark, [(i, "some text here", f"l{i % 40:02}") for i in range(45)])
    languages, matrix = language_id.fit(docs, most=10)
    assert languages == [f"l{i:02}" for i in range(10)] and matrix.shape[0] == 10


def test_blocks_and_awkward_rows(spark, monkeypatch):
    rows = [*awkward(), *[(100 + i, "the cat and the dog " * 9, "en") for i in range(9)], *[(200 + i, "le chat et le chien " * 9, "fr") for i in range(9)], (300, "12 34 !!")]
    docs = documents(spark, rows)
    model = language_id.fit(docs)
    a = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 4)) for r in language_id.predict(docs, *model).collect())
    assert ("1", "und", 0.0) in a and ("300", "und", 0.0) in a and any(x[:2] == ("105", "en") for x in a) and any(x[:2] == ("205", "fr") for x in a)
    monkeypatch.setattr(language_id, "BLOCK", 50)
    b = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 4)) for r in language_id.predict(docs, *model).collect())
    assert a == b and len(a) == len(rows)
    assert language_id.predict(docs.limit(0), *model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, *nothing).collect()} == {"und"}
