"""Small tables with awkward rows, and plain versions of the operators' rules."""

import collections
import random
import zlib

#: Columns that operators use for themselves inside.
CLASHES = ("_e", "_i", "_n", "_doc", "_g", "_copy", "_shard", "d", "h", "again", "s", "root", "_row", "_size", "_h", "_d", "base", "alike", "added", "shard", "at", "node", "n", "counts", "x", "score", "label", "taken", "_key", "dim", "rep")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def documents(spark, rows):
    """Documents of (doc_id, text[, lang, source]) with a column of every clashing name."""
    full = []
    for row in rows:
        doc_id, text, lang, source = [*row, None, None][:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text), *["c"] * len(CLASHES)))
    return spark.createDataFrame(full, SCHEMA)


def crc(x):
    return zlib.crc32(str(x).encode())


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward():
    """Rows with nulls everywhere, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = " ".join(words(rng, 30_000))
    return [(1, None), (2, ""), (3, " \t\n"), (None, "no id here"), (4, "one"), (4, "one"), (5, long, "en", "s"), (6, "ONE", None, None), (None, None), (7, "é " * 50 + "🙂 x", "fr", "")]


def components(ids, sets, num, den):
    """(set size, smallest linked id) by comparing all pairs that share an element."""
    lists, parent = collections.defaultdict(list), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        met = collections.Counter()
        for g in s:
            met.update(lists[g])
            lists[g].append(i)
        for j, o in met.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
