import random

import pytest
from helpers import awkward, documents
from tokenizers import Tokenizer

from tidemark.llm import queries, token_counts

DATA = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path("word_bpe_49k.json")
TEXTS = ["", "  ", "ΑΣ ΟΔΟΣ σ", "İstanbul ½ ² Ⅷ x́é", "a\x1cb\x85c　d", "don't we're 'll 'x !!'s <|endoftext|>abc<|startoftext|> <|ENDOFTEXT|>", "日本語テキスト 🙂🙂👍🏽", "a" * 3000, "!" * 2000, "'''''", "नमस्ते दुनिया", "​﻿x", "\x00a\x7f"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(open(PATH).read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_exact(counter, library):
    rng = random.Random(8)
    for word in ["thereforethe", "'re", "'ll", "naïveté", "🙂👍🏽", "aaaaaaaa", "!!!'", "".join(rng.choice("etaoinshr") for _ in range(40))]:
        word = counter.normal(word)
        for piece in counter.pieces(word):
            assert counter.table(piece) == [count(library, piece[:i]) for i in range(len(piece) + 1)]


def test_budgets(counter, library):
    for text in [*TEXTS, "The quick brown fox, it's 12 o'clock!"]:
        if "<|" in text:
            continue
        normal = counter.normal(text)
        for budget in (0, 1, 2, 5, 17):
            n = counter.prefixes(text).longest(budget)
            assert count(library, normal[:n]) <= budget and (n == len(normal) or count(library, normal[: n + 1]) > budget)


def test_stored_prefixes(counter, library):
    """Every prefix of a whole text, from the stored counts alone."""
    for text in [*TEXTS, "The quick brown fox, it's 12 o'clock!"]:
        if "<|" in text or len(text) > 200:
            continue
        normal, stored = counter.normal(text), counter.prefixes(text)
        assert stored.length == len(normal)
        assert [stored.count(n) for n in range(len(normal) + 1)] == [count(library, normal[:n]) for n in range(len(normal) + 1)]
    stored = counter.prefixes("ab <|endoftext|> cd")
    assert stored.total() == count(library, "ab <|endoftext|> cd") == counter.total_count("ab <|endoftext|> cd")
    assert stored.longest(1) == 3 and stored.longest(2) == 17


def test_letters_newer_than_this_python(counter, library):
    for text in ("\ua7cb", "x\ua7dc y", "\ua7cb\ua7dc\u03a3"):
        assert counter.total_count(text) == counter.prefixes(text).total() == count(library, text)


def test_rows(spark, library):
    rows = [*awkward(), *[(100 + i, t) for i, t in enumerate(TEXTS)]]
    got = token_counts.token_counts(documents(spark, rows), open(PATH).read(), limit=50).collect()
    key = lambda i, n, t: (str(i), n, t, t > 50)
    want = sorted(key(i, len((t or "").encode()), count(library, t or "")) for i, t, *_ in rows)
    assert sorted(key(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in got)
    assert token_counts.token_counts(documents(spark, rows).limit(0), open(PATH).read()).count() == 0


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, DATA, "documents").collect()}
    for r in queries.op6_token_counts(spark, DATA).collect():
        assert r["n_tokens"] == count(library, texts[r["doc_id"]]) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
