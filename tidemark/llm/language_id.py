"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of each language's rows; the matrix of log-probabilities (buckets x
languages, bounded by BUCKETS) travels with the plan and batches of texts are scored in numpy.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Characters a block of texts may hold while it is scored; long texts are scored in several blocks.
BLOCK = 1 << 20


#: Set in a table's entry of a mark, which stays with its letters but is none.
MARK = 1 << 31


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, a mark with MARK added, or 32 where it is neither."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            table[c] = (ord(low) if len(low) == 1 else c) + (MARK if kind == "M" else 0)
    return table


def grams(text: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that end at each place of text (letters, 32 between words); -1 where there is none.

    A gram of length n needs a letter at its end and no gap inside except at its beginning."""
    x = text.astype(np.uint64)
    gap = text == 32
    out, key = [], np.zeros(len(x), dtype=np.uint64)
    for n in ORDERS:
        key = key.copy()
        key[n - 1 :] += x[: len(x) - n + 1] * np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) & 0xFFFFFFFFFFFFFFFF)
        bucket = ((key * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) >> np.uint64(48)).astype(np.int32)
        none = gap.copy()
        for k in range(1, n - 1):
            none[k:] |= gap[: len(gap) - k]
        none[: n - 1] = True
        bucket[none] = -1
        out.append(bucket)
    return out


def code_points(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each after a gap, as one array of letters, and where each begins."""
    joined = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return table[joined], np.concatenate([[0], np.cumsum(lengths)])[:-1]


def blocks(texts: list[str]):
    """(row, part of a text) lists of up to BLOCK characters; a part repeats the last two characters before it."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), BLOCK):
            part = text[max(0, at - 2) : at + BLOCK]
            held.append((row, part, min(at, 2)))
            size += len(part) + 1
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def fit(docs: DataFrame, per_language: int = 4000, learn: Column | None = None, most: int = 256) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [language, bucket]) from up to about per_language rows of each language.

    learn: which rows may be learnt from. most: the languages that are learnt, those of the most rows (ties: the one
    that sorts first); it bounds the matrix, whatever stands in dirty columns. The sample keeps rows by a hash of
    text and id at a rate set by the language's count; all statistics over the sample are summed before they reach
    the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))]), F.col("lang"))
    place = {k: i for i, k in enumerate(languages)}
    picked = rows.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64("doc_id", "lang", F.length("text")), F.lit(1 << 20)) < rate * (1 << 20))

    def count(batches):
        table = common.worker_cache("letters", letter_table)
        held, size = [], 0

        def flush():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            names = pa.array(languages).take(pa.array(at // BUCKETS))
            return pa.RecordBatch.from_arrays([names, pa.array(at % BUCKETS, pa.int32()), pa.array(n)], names=["lang", "bucket", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in blocks(batch.column("text").to_pylist()):
                for row, part, skip in block:
                    for bucket in grams(code_points([part], table)[0]):
                        bucket = bucket[skip + 1 :]  # what the part before has counted
                        held.append(bucket[bucket >= 0] + place[langs[row]] * BUCKETS)
                        size += len(held[-1])
                if size >= 4 * BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    sums = picked.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    matrix = np.full((len(languages), BUCKETS), 0.5)
    found = sums.toArrow()  # at most BUCKETS rows a language
    np.add.at(matrix, ([place[k] for k in found.column("lang").to_pylist()], found.column("bucket").to_numpy()), found.column("n").to_numpy())
    return languages, np.log(matrix / matrix.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray) -> DataFrame:
    """Per row: doc_id, lang_pred and score, the posterior probability of the predicted language tempered by
    the number of letters and marks (mean log-probabilities times the square root of that number).

    `und` with score 0 where the text is null or has no letter (marks alone are none), or where nothing was learnt. Ties go to the
    language that sorts first; repeated rows and null ids stay; other columns are not read."""
    weights = matrix.astype(np.float32)

    def score(batches):
        table = common.worker_cache("letters", letter_table)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sums, letters, real = np.zeros((len(texts), len(languages))), np.zeros(len(texts)), np.zeros(len(texts))
            for block in blocks(texts):
                x, starts = code_points([p for _, p, _ in block], table)
                rows = np.array([r for r, _, _ in block])
                skip = (starts[:, None] + np.array([[1 if k > 0 else 0, 2 if k > 1 else 0] for _, _, k in block])).ravel()
                first = np.zeros(len(x), dtype=bool)
                first[skip[np.repeat(np.array([k > 0 for _, _, k in block]), 2)]] = True
                found = grams(x)
                np.add.at(letters, rows, np.add.reduceat((x != 32) & ~first, starts, dtype=np.int64))
                np.add.at(real, rows, np.add.reduceat((x != 32) & (x < MARK), starts, dtype=np.int64))
                for bucket in found:
                    bucket[first] = -1
                    bucket[starts] = -1
                for j in range(len(languages)):
                    w = np.append(weights[j], np.float32(0))
                    each = w[found[0]]
                    for bucket in found[1:]:
                        each = each + w[bucket]
                    np.add.at(sums[:, j], rows, np.add.reduceat(each, starts, dtype=np.float64))
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if languages:
                mean = sums / np.sqrt(np.maximum(letters, 1))[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                names = [languages[b] if n else "und" for b, n in zip(best, real, strict=True)]
                scores = np.where(real > 0, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
