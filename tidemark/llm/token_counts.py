"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges.

A byte-pair encoding has one valid last token for each prefix: the token t that ends there such that the
encoding of what precedes it, followed by t, survives the merges. So one pass over a word gives the token
count of each of its prefixes, and a running sum over words gives that of each prefix of a document. Both are stored
(Prefixes), so budget and truncation questions are binary searches; nothing is encoded again.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "</w>"
#: The vocabulary file's own word pattern and the white space that its library knows.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that the library puts in lower case in its own way, or that this Python's tables don't know yet.
LOWER = {0x3A3: 0x3C3, 0xA7CB: 0x264, 0xA7DC: 0x19B}
#: Words a worker remembers before it forgets them all; only speed depends on it.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """One printable letter per byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Words(dict):
    """Token counts of whole words, filled on demand."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.count(word)
        return n


class PrefixCounter:
    """Prefix token counts for a byte-pair vocabulary with word ends (a tokenizers .json file's content)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        # What a run of letters is: 1 a token inside words, 2 a token at their ends, 0 only a token's beginning.
        self.kinds: dict[str, int] = {}
        for token in model["vocab"]:
            own = token.removesuffix(END)
            for j in range(1, len(own)):
                self.kinds.setdefault(own[:j], 0)
            self.kinds[own] = self.kinds.get(own, 0) | (2 if token.endswith(END) else 1)
        self.letters = byte_letters()
        self.fits: dict[tuple[str, str, bool], bool] = {}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = Words(self.total)
        short = "|".join(CONTRACTIONS)
        self.any_word = regex.compile(rf"{short}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.latin_word = re.compile(rf"{short}|[{kinds['L']}]+|[{kinds['N']}]|[^{SPACE}{kinds['L']}{kinds['N']}]+")
        self.beyond_latin = re.compile("[^\x00-ɏ]")

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, used on two tokens at a time."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def fit(self, a: str, b: str, end: bool) -> bool:
        """Whether token b may follow token a: merging their letters gives the two back."""
        key = (a, b, end)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 4_000_000:
                self.fits.clear()
            tail = END if end else ""
            known = self.fits[key] = self.merged([*a, *b[:-1], b[-1] + tail]) == [a, b + tail]
        return known

    def table(self, word: str) -> list[int]:
        """Token counts of the prefixes of a word by characters: entry i is that of its first i, from 0."""
        if len(word) == 3 and word in CONTRACTIONS:  # cut in the middle, it is no longer one word
            return [0, self.words["'"], self.words["'"] + self.words[word[1]], self.run(word)[3]]
        return self.run(word)

    def total(self, word: str) -> int:
        return self.run(word, whole=True)[-1]

    def run(self, word: str, whole: bool = False) -> list[int]:
        """The dynamic program: count and last token of each prefix, without and with a word end.

        whole: the ended count is wanted for the whole word only."""
        kinds, fit = self.kinds, self.fit
        plain = word.isascii() and word.isprintable()
        data = word.encode()
        s = word if plain else "".join([self.letters[b] for b in data])
        n = len(s)
        counts, lasts, ended = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        for i in range(n):
            before, more = lasts[i], counts[i] + 1
            for j in range(i + 1, n + 1):
                t = s[i:j]
                kind = kinds.get(t)
                if kind is None:
                    break
                if kind & 1 and not counts[j] and (not i or fit(before, t, False)):
                    counts[j], lasts[j] = more, t
                if kind & 2 and not ended[j] and (j == n or not whole) and (not i or fit(before, t, True)):
                    ended[j] = more
        if whole:
            return ended
        return ended if plain else [0] + [ended[j] for j in range(1, n + 1) if j == n or data[j] & 0xC0 != 0x80]

    def normal(self, text: str) -> str:
        """Composed, lower case letter by letter."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.translate(LOWER).lower()

    def pieces(self, text: str) -> list[str]:
        return self.word_pattern(text).findall(text)

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Runs of ordinary text (normalised) and special tokens, in order."""
        if self.special is None or "<" not in text:
            return [(self.normal(text), False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(self.normal(text[at : m.start()]), False), (m[0], True)]
            at = m.end()
        return [*out, (self.normal(text[at:]), False)]

    def total_count(self, text: str) -> int:
        """Tokens of a whole text, where nothing is asked of its prefixes."""
        return sum(1 if special else sum(map(self.words.__getitem__, self.pieces(run))) for run, special in self.split(text))

    def word_pattern(self, run: str):
        return self.any_word if self.beyond_latin.search(run) else self.latin_word

    def prefixes(self, text: str) -> Prefixes:
        """One pass over a text that stores what all questions about its prefixes need."""
        runs = [(run, special, [run] if special else self.pieces(run)) for run, special in self.split(text)]
        counts: list[int] = []
        for _, special, words in runs:
            counts += [1] if special else map(self.words.__getitem__, words)
        return Prefixes(self, runs, np.cumsum(np.array(counts, dtype=np.int64)))


class Prefixes:
    """Token counts of all prefixes of a normalised text: running counts at the ends of words, and each word's own table.

    A special token counts whole or not at all; the characters that a cut leaves of it stand outside the prefix. Where
    the words stand is found out with the first question that needs it, as most texts are only asked for their total."""

    def __init__(self, counter: PrefixCounter, runs: list[tuple[str, bool, list[str]]], counts: np.ndarray):
        self.counter, self.runs, self.counts = counter, runs, counts

    def word(self, i: int) -> tuple[str, int, bool]:
        """(word number i, where it begins, whether it is a special token)."""
        done = 0
        for run, special, words in self.runs:
            if i < len(words):
                inside = 0 if special else next(itertools.islice(self.counter.word_pattern(run).finditer(run), i, None)).start()
                return words[i], done + inside, special
            i -= len(words)
            done += len(run)
        raise IndexError(i)

    @functools.cached_property
    def ends(self) -> np.ndarray:
        """Where all words end."""
        out: list[int] = []
        done = 0
        for run, special, _ in self.runs:
            out += [done + len(run)] if special else [done + m.end() for m in self.counter.word_pattern(run).finditer(run)]
            done += len(run)
        return np.array(out, dtype=np.int64)

    @property
    def length(self) -> int:
        return sum(len(run) for run, _, _ in self.runs)

    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def count(self, chars: int) -> int:
        """Tokens of the first `chars` characters."""
        i = int(np.searchsorted(self.ends, chars, side="right"))
        whole = int(self.counts[i - 1]) if i else 0
        if i == len(self.counts):
            return whole
        word, begin, special = self.word(i)
        return whole if special or chars <= begin else whole + self.counter.table(word)[chars - begin]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix that fits a budget of tokens."""
        i = int(np.searchsorted(self.counts, budget, side="right"))
        if i == len(self.counts):
            return self.length
        word, begin, special = self.word(i)
        spent = int(self.counts[i - 1]) if i else 0
        return begin if special else begin + [k for k, c in enumerate(self.counter.table(word)) if spent + c <= budget][-1]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit and cut_chars.

    vocabulary: the content of a byte-pair .json file with word ends; it travels with the plan (2 MB).
    limit: the budget of over_limit and of cut_chars, the characters of the normalised text (composed, lower
    case) that fit into it. Null and empty texts have 0 tokens; repeated rows and null ids stay as they are;
    other columns are not read."""
    mark = common.digest(vocabulary)

    def count(batches):
        counter = common.worker_cache(f"prefix{mark}", lambda: PrefixCounter(vocabulary))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                if len(text) * 4 <= limit:  # as many tokens as bytes at most, so no prefix is asked for
                    out.append((counter.total_count(text), False, len(text)))
                    continue
                table = counter.prefixes(text)
                over = table.total() > limit
                out.append((table.total(), over, table.longest(limit) if over else len(text)))
            total, over, cut = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(total, pa.int64()), pa.array(over, pa.bool_()), pa.array(cut, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
