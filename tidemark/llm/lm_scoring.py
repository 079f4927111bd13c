"""Language-model scores by a weighted backoff automaton.

The states are the histories of all n-grams that occur at least twice in the training texts, so they grow with the
corpus. The arc of a word leads from its history to the longest kept suffix and weighs its smoothed probability; the
failure arc of a history, which weighs what smoothing took from its arcs, leads to the next shorter one. Probabilities
interpolate absolute discounting: p(w | h) = max(n - d, 0) / c + fail(h) p(w | shorter h), which sums to one.

States are a written table. Each carries what it adds to the log-probability of a place over its shorter suffixes, and
the weight of its own failure arc, which the walk pays at the next place if it leaves from there. So the sum that a
left-to-right walk carries along a text is one over its places and orders, and each is looked up on its own: n-grams go
to buckets by their hash, in which numpy finds them among the states, and sums by text come back. A word is keyed by a
64-bit hash, an n-gram by one of its history's key and its tail's.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Places that a task counts before it sends their sums on; occurrences from which a history is dealt to several groups.
BLOCK, HOT = 1_000_000, 500_000
#: Bytes of text that are held at once, that of these are hashed at once, and that fall to one bucket of states.
BLOCK_BYTES, HASH_BYTES, BUCKET_BYTES = 4_000_000, 250_000, 4_000_000
#: Parts that n-grams of three or more words are counted in, by history, and that the texts are scored in, one after the
#: other, as n-grams on their way fill the disk.
COUNT_PARTS, PARTS = 2, 4
U = np.uint64


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def extended(history: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their words but the last and of their words but the first."""
    return mixed(history * U(0x9E3779B97F4A7C15) + tail * U(0xD6E8FEB86659FD93) + U(0xA0761D6478BD642F))


STEP = 0xF1357AEA2E62A9C5
BYTE = np.random.default_rng(9).integers(1, 1 << 64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z count as lower case
END_KEY = U(0x2545F4914F6CDD1D)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the words of all texts, END_KEY after each text, and how many places each text has."""
    up, down = common.worker_cache("powers", lambda: [powers(x, 2 * HASH_BYTES) for x in (STEP, pow(STEP, -1, 1 << 64))])
    parts = [hashed_part(texts[a:b], up, down) for a, b in blocks(texts, HASH_BYTES)]
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def hashed_part(texts: list[bytes], up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As hashed(), of few texts; up and down: powers of STEP and of its inverse, which only a long text needs more of."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if len(data) > len(up):
        up, down = powers(STEP, len(data)), powers(pow(STEP, -1, 1 << 64), len(data))
    white = np.ones(len(data) + 1, dtype=bool)
    white[1:] = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(white[1:] != white[:-1])
    begins, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE.take(data) * up[: len(data)], out=sums[1:])
    words = mixed((sums[ends] - sums[begins]) * down[begins])
    borders = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    sizes = np.bincount(np.searchsorted(borders, begins, side="right"), minlength=len(texts)) + 1
    x = np.full(sizes.sum(), END_KEY)
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False
    x[inner] = words
    return x, sizes


def blocks(texts: list[bytes], limit: int):
    """(begin, end) of runs of texts of about limit bytes."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < limit):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


def runs(x: np.ndarray, sizes: np.ndarray, order: int):
    """For orders from 2 on, (places, histories' keys, tails' keys) of the n-grams that lie within a text."""
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = x
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)
        history, tail = key[at - 1], key[at]
        yield at, history, tail
        if n < order:
            key = np.zeros_like(x)
            key[at] = extended(history, tail)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key, of n."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def packs(group: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """The groups there are, and each array's part for each of them."""
    low = len(group) and int(group.max()) < 1 << 16  # short numbers are sorted by their digits
    by = np.argsort(group.astype(np.uint16) if low else group, kind="stable")
    return cut_up(group[by], *(x[by] for x in arrays))


def cut_up(group: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """As packs(), of arrays that stand by group."""
    begins = run_begins(group)
    cut = [*begins.tolist(), len(group)]
    return group[begins].tolist(), [[a[cut[i] : cut[i + 1]].tobytes() for i in range(len(begins))] for a in arrays]


def run_begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def equal_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order that sorts keys, the places in it where a new key begins, how often each key occurs)."""
    by = np.argsort(keys)  # not a stable sort, which is several times slower
    begins = run_begins(keys[by])
    return by, begins, np.diff(begins, append=len(keys))


def batch_of(group: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """A row per group with each array's part, packed."""
    own, parts = packs(group, *arrays.values())
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=["bucket", *arrays])


def unpacked(column, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=kind)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, with sums of their values."""
    by, begins, _ = equal_runs(keys)
    return keys[by[begins]], [np.add.reduceat(v[by], begins, dtype=np.float64) if len(by) else np.zeros(0) for v in values]


class Known:
    """Sorted keys with values, few enough to travel with the plan."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray, in_order: bool = False):
        by = slice(None) if in_order else np.argsort(keys)
        self.keys, self.values = keys[by], [v[by] for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are here, where each of them is)."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


class Groups:
    """Where n-grams are counted: by their history's bucket, or for a hot history, by tail in several groups of its own."""

    def __init__(self, buckets: int, hot: Known):
        self.buckets, self.hot = buckets, hot
        self.ways = -(-hot.values[0].astype(np.int64) // HOT)
        self.first = buckets + np.cumsum(self.ways) - self.ways

    def of(self, history: np.ndarray, tail: np.ndarray) -> np.ndarray:
        group = bucket_of(history, self.buckets)
        hit, at = self.hot.find(history)
        at = at[hit]
        group[hit] = self.first[at] + (mixed(tail[hit]) % self.ways[at].astype(np.uint64)).astype(np.int64) if len(at) else 0
        return group


def counted(texts: DataFrame, keys_of, group_of, names: list[str], add, schema: str) -> DataFrame:
    """add()'s table of each group of what keys_of() finds in the texts. A task sums up some million places before it sends them."""

    def send(batches):
        held, seen = [], 0

        def flush():
            arrays = [np.concatenate(a) for a in zip(*held, strict=True)]
            held.clear()
            key, group = extended(*arrays) if len(arrays) > 1 else arrays[0], group_of(*arrays)
            # In order of groups and, but for their last bits, of keys: rows that this keeps apart meet in their group.
            bits = U(int(group.max()).bit_length())
            by = np.argsort(group.astype(np.uint64) << U(64) - bits | key >> bits) if bits else np.argsort(key)
            begins = run_begins(key[by])
            first = by[begins]
            own, parts = cut_up(group[first], *(a[first] for a in arrays), np.diff(begins, append=len(key)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=["bucket", *names, "n"])

        for batch in batches:
            data = common.text_bytes(batch.column("text"))
            for begin, end in blocks(data, BLOCK_BYTES):
                held.append(keys_of(*hashed(data[begin:end])))
                seen += len(held[-1][0])
                if seen >= BLOCK:
                    yield flush()
                    seen = 0
        if seen:
            yield flush()
        common.give_back()

    sent = texts.select("text").mapInArrow(send, f"bucket int, {', '.join(f'{x} binary' for x in names)}, n binary")
    return common.materialise(sent.groupBy("bucket").applyInArrow(add, schema))


def word_sums(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, n, tokens, words): all words of a bucket with their counts, packed, and the sums of both."""

    def add(table):
        keys, (n,) = summed(unpacked(table.column("key")), unpacked(table.column("n"), np.int32))
        return pa.table({
            "bucket": table.column("bucket")[:1], "key": pa.array([keys.tobytes()], pa.binary()), "n": pa.array([n.astype(np.int64).tobytes()], pa.binary()),
            "tokens": pa.array([int(n.sum())]), "words": pa.array([len(keys)]),
        })

    return counted(texts, lambda x, sizes: (x,), lambda keys: bucket_of(keys, buckets), ["key"], add, "bucket int, key binary, n binary, tokens long, words long")


def gram_sums(texts: DataFrame, order: int, least: int, discount: float, groups: Groups) -> DataFrame:
    """One row per group: of, tail, n of the n-grams that occur `least` times; history, c, free of their histories (`of` points
    there): all occurrences, and what discounting leaves to arcs. A hot history's groups have parts of its c and free."""
    buckets, parts = groups.buckets, COUNT_PARTS if order > 2 else 1

    def keys_of(x, sizes, part):
        *_, (_, history, tail) = runs(x, sizes, order)
        if parts == 1:
            return history, tail
        own = (history >> U(7)) % U(parts) == U(part)
        return history[own], tail[own]

    def add(table):
        group = table.column("bucket")[0].as_py()
        history, tail = unpacked(table.column("history")), unpacked(table.column("tail"))
        by, begins, _ = equal_runs(extended(history, tail))
        n = np.add.reduceat(unpacked(table.column("n"), np.int32)[by], begins, dtype=np.float64)
        history, tail = history[by[begins]], tail[by[begins]]
        kept = n >= least
        own, of = np.unique(history, return_inverse=True)
        c = np.bincount(of, weights=n, minlength=len(own))
        free = np.bincount(of[kept], weights=n[kept] - discount, minlength=len(own))
        is_hot = group >= buckets
        used = np.ones(1, dtype=bool) if is_hot else np.bincount(of[kept], minlength=len(own)) > 0
        of = (np.cumsum(used) - 1)[of[kept]]
        out = {"of": of.astype(np.int32), "tail": tail[kept], "n": n[kept].astype(np.int64), "history": own[used], "c": c[used], "free": free[used]}
        return pa.table({
            "bucket": pa.array([group], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in out.items()},
            "hot": pa.array([int(own[:1].view(np.int64)[0]) if is_hot else None], pa.int64()), "hot_c": pa.array([float(c[0])]), "hot_free": pa.array([float(free[0])]),
        })

    schema = "bucket int, of binary, tail binary, n binary, history binary, c binary, free binary, hot long, hot_c double, hot_free double"
    out = None
    for part in range(parts):
        own = counted(texts, functools.partial(keys_of, part=part), groups.of, ["history", "tail"], add, schema)
        out = own if out is None else out.unionByName(own)
    return out


class Histories:
    """Reads gram_sums() rows, with the whole sums of hot histories."""

    def __init__(self, sums: DataFrame, discount: float):
        hot = sums.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("hot_c").alias("c"), F.sum("hot_free").alias("free"), F.min("bucket").alias("lead")).toArrow()
        columns = [hot.column(c).to_numpy() for c in ("c", "free", "lead")]  # at most as many rows as Groups has hot histories
        self.hot, self.discount = Known(hot.column("hot").to_numpy().view(np.uint64), *columns), discount

    def read(self, row: dict):
        """(history of each n-gram, tail, n, arc, fail, histories, their fails, whether this row speaks for them)."""
        of, n = np.frombuffer(row["of"], np.int32), np.frombuffer(row["n"], np.int64)
        own, c, free = np.frombuffer(row["history"], np.uint64), np.frombuffer(row["c"]), np.frombuffer(row["free"])
        lead = True
        if row["hot"] is not None:
            _, at = self.hot.find(own)
            c, free = self.hot.values[0][at], self.hot.values[1][at]
            lead = self.hot.values[2][at[0]] == row["bucket"]
        fail = 1 - free / c
        return own[of], np.frombuffer(row["tail"], np.uint64), n, (n - self.discount) / c[of], fail[of], own, fail, lead


ENTRY = "bucket int, key binary, more binary, base binary"


def fails(sums: DataFrame, histories: Histories, buckets: int) -> DataFrame:
    """Entries (bucket, key, more, base) with the failure arcs of all histories."""

    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *_, own, fail, lead = histories.read(row)
                if lead and len(own):
                    own, fail = own[fail < 1], np.log10(fail[fail < 1])
                    yield batch_of(bucket_of(own, buckets), key=own, more=fail, base=np.zeros(len(own)))

    return sums.mapInArrow(each, ENTRY)


def arcs(sums: DataFrame, histories: Histories, shorter: DataFrame, known: Known, buckets: int) -> DataFrame:
    """(bucket, key, n, p, more), packed: n-grams with their probabilities and what they add to their tails'.

    shorter: (bucket, key, p), the n-grams of one word less. Those in known, which many n-grams end in, aren't asked for
    there; the others occur too seldom for their bucket to grow large."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                history, tail, n, arc, fail, *_ = histories.read(row)
                if not len(tail):
                    continue
                key = extended(history, tail)
                hit, at = known.find(tail)
                below = np.where(hit, known.values[0][at], np.nan) if len(known.keys) else np.full(len(key), np.nan)
                yield batch_of(bucket_of(np.where(hit, key, tail), buckets), key=key, tail=tail, n=n, arc=arc, fail=fail, below=below)

    def answer(asked, held):
        tail, n, arc, fail, below = (unpacked(asked.column(c), t) for c, t in (("tail", U), ("n", np.int64), ("arc", float), ("fail", float), ("below", float)))
        key = unpacked(asked.column("key"))
        keys, (p,) = summed(unpacked(held.column("key")), unpacked(held.column("p"), float))
        below = below.copy()
        open_ = np.isnan(below)
        if open_.any():
            below[open_] = p[np.searchsorted(keys, tail[open_])]  # the tail of a kept n-gram is kept
        return pa.Table.from_batches([batch_of(bucket_of(key, buckets), key=key, n=n, p=arc + fail * below, more=np.log10(1 + arc / (fail * below)))])

    asked = sums.mapInArrow(ask, "bucket int, key binary, tail binary, n binary, arc binary, fail binary, below binary").groupBy("bucket")
    found = asked.cogroup(shorter.select("bucket", "key", "p").groupBy("bucket")).applyInArrow(lambda a, b: answer(a, b) if a.num_rows else EMPTY, "bucket int, key binary, n binary, p binary, more binary")
    return common.materialise(found)


EMPTY = pa.table({"bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("key", "n", "p", "more")}})


def picked(table: DataFrame, names: dict[str, type], choose) -> Known:
    """Those n-grams of packed rows that choose(array of the first name's values by key) wants, on the driver."""

    def each(batches):
        for batch in batches:
            key = unpacked(batch.column("key"))
            values = [unpacked(batch.column(c), t) for c, t in names.items()]
            want = choose(key, values[0])
            yield pa.RecordBatch.from_arrays([pa.array(key[want].view(np.int64)), *(pa.array(v[want]) for v in values)], names=["key", *names])

    kinds = {np.int64: "long", float: "double"}
    found = table.select("key", *names).mapInArrow(each, f"key long, {', '.join(f'{c} {kinds[t]}' for c, t in names.items())}").toArrow()
    return Known(found.column("key").to_numpy().view(np.uint64), *(found.column(c).to_numpy() for c in names))


def with_column(table: DataFrame, name: str, kind: type, of: str, f) -> DataFrame:
    """Packed rows (bucket, key, of) as (bucket, key, name), name by f of `of`."""

    def each(batches):
        for batch in batches:
            out = [f(np.frombuffer(x, kind)).tobytes() for x in batch.column(of).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("key"), pa.array(out, pa.binary())], names=["bucket", "key", name])

    return table.select("bucket", "key", of).mapInArrow(each, f"bucket int, key binary, {name} binary")


def merged(entries):
    """One row of a bucket's entries: each key once, in order, with the sums of its parts."""
    keys, more, base = [], [], []
    for key, m, b in zip(*(entries.column(c).to_pylist() for c in ("key", "more", "base")), strict=True):
        keys.append(np.frombuffer(key, np.uint64))
        more.append(np.frombuffer(m) if m else np.zeros(len(keys[-1])))
        base.append(np.frombuffer(b) if b else np.zeros(len(keys[-1])))
    own, sums = summed(*map(np.concatenate, (keys, more, base)))
    return pa.table({"bucket": entries.column("bucket")[:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("key", "more", "base"), (own, *sums), strict=True)}})


class Model:
    """The automaton: entries, a table of all keys' (bucket, key, more, base), packed in one row a bucket; common words with
    their base and more, which travel with the plan; the number of training tokens; and what a word's count is divided by.

    base: log10(count + 0.5) of a word, which is above 0. A key has up to three parts, which add up."""

    def __init__(self, texts: DataFrame, share: float, least: int, order: int, discount: float):
        spark = texts.sparkSession
        size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
        self.buckets = buckets = max(2 * spark.sparkContext.defaultParallelism, size // BUCKET_BYTES)
        with common.scratch(spark):
            words = word_sums(texts, buckets)
            sums = words.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).collect()[0]
            self.tokens = sums["n"] or 0
            self.unseen = unseen = self.tokens + 0.5 * ((sums["v"] or 0) + 1)
            often = max(1.0, share * self.tokens)  # 1 / share keys at most
            frequent = picked(words, {"n": np.int64}, lambda key, n: n >= often)
            parts = [with_column(words, "base", np.int64, "n", lambda n: np.log10(n + 0.5)).withColumn("more", F.lit(None).cast("binary"))]
            shorter = with_column(words, "p", np.int64, "n", lambda n: (n + 0.5) / unseen)
            known, counts = Known(frequent.keys, (frequent.values[0] + 0.5) / unseen), frequent
            more = np.zeros(len(frequent.keys))
            for n in range(2, order + 1):
                hot = counts.values[0] >= max(HOT, often)
                grams = gram_sums(texts, n, least, discount, Groups(buckets, Known(counts.keys[hot], counts.values[0][hot])))
                histories = Histories(grams, discount)
                back = fails(grams, histories, buckets)
                if n == 2:
                    weights = picked(back, {"more": float}, lambda key, _, f=frequent: f.find(key)[0])
                    hit, at = weights.find(frequent.keys)
                    more[hit] = weights.values[0][at[hit]]
                own = arcs(grams, histories, shorter, known, buckets)
                parts += [back.withColumn("base", F.lit(None).cast("binary")), own.select("bucket", "key", "more").withColumn("base", F.lit(None).cast("binary"))]
                if n < order:
                    limit = max(HOT, often)
                    found = picked(own, {"n": np.int64, "p": float}, lambda key, n, limit=limit: n >= limit)
                    counts, known, shorter = Known(found.keys, found.values[0]), Known(found.keys, found.values[1]), own
            entries = parts[0].select("bucket", "key", "more", "base")
            for part in parts[1:]:
                entries = entries.unionByName(part)
            self.entries = common.materialise(entries.groupBy("bucket").applyInArrow(merged, ENTRY), outer=True)
        self.common = Known(frequent.keys, np.log10(frequent.values[0] + 0.5), more)


DOC = "doc_id long, n_tokens long, n_known long, base double, score double"


def walked(rows: DataFrame, model: Model, order: int) -> DataFrame:
    """A row per text with its number of tokens and known ones, and the sums of what its places add to base and score."""
    buckets, often = model.buckets, model.common

    def walk(batches):
        """One row a block with its documents, and the keys that it asks for packed by bucket."""
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, ids = common.text_bytes(batch.column("text")), batch.column("doc_id")
            for begin, end in blocks(data, BLOCK_BYTES):
                x, sizes = hashed(data[begin:end])
                starts = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
                hit, at = often.find(x)
                base, more = (np.where(hit, v[at], 0.0) if len(v) else np.zeros(len(x)) for v in often.values)
                info = pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(sizes), pa.array(np.add.reduceat(hit, starts, dtype=np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(more, starts))],
                    names=["doc_id", "n_tokens", "n_known", "base", "score"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as out:
                    out.write_batch(info)
                asked = [(x[~hit], doc[~hit]), *((extended(h, t), doc[at]) for at, h, t in runs(x, sizes, order))]
                keys, of = (np.concatenate(a) for a in zip(*asked, strict=True))
                by = np.argsort(keys)  # by bucket as well, and each bucket finds keys faster in order
                own, (keys, of) = cut_up(bucket_of(keys[by], buckets), keys[by], of[by])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*own, block % buckets], pa.int32()), pa.array([block] * (len(own) + 1)), pa.array([*keys, b""], pa.binary()), pa.array([*of, b""], pa.binary()), pa.array([None] * len(own) + [sink.getvalue().to_pybytes()], pa.binary())],
                    names=["bucket", "block", "keys", "docs", "info"],
                )
                block += 1
        common.give_back()

    def find(asked, entries):
        """Per block, what the bucket's states add to its documents."""
        held = Known(*(unpacked(entries.column(c), t) for c, t in (("key", U), ("more", float), ("base", float))), in_order=True)
        where, docs_of, sums_of, infos = [], [], [], []
        for block, keys, of, info in zip(*(asked.column(c).to_pylist() for c in ("block", "keys", "docs", "info")), strict=True):
            keys, of = np.frombuffer(keys, np.uint64), np.frombuffer(of, np.int32)
            hit, at = held.find(keys)
            if info is None and not hit.any():
                continue
            at, of = at[hit], of[hit]
            own = np.flatnonzero(np.bincount(of)).astype(np.int32)
            more, base = (v[at] for v in held.values)
            where.append(block)
            docs_of.append(own.tobytes())
            sums_of.append(np.stack([np.bincount(of, weights=v)[own] for v in (base > 0, base, more)], axis=1).tobytes() if len(own) else b"")
            infos.append(info)
        return pa.table({"block": pa.array(where, pa.int64()), "docs": pa.array(docs_of, pa.binary()), "sums": pa.array(sums_of, pa.binary()), "info": pa.array(infos, pa.binary())})

    def gather(table):
        """A block's documents with their sums."""
        own = pa.ipc.open_stream(next(x for x in table.column("info").to_pylist() if x is not None)).read_all()
        of, sums = unpacked(table.column("docs"), np.int32), unpacked(table.column("sums"), float).reshape(-1, 3)
        for i, (name, kind) in enumerate([("n_known", np.int64), ("base", float), ("score", float)]):
            total = own.column(name).to_numpy() + np.bincount(of, weights=sums[:, i], minlength=own.num_rows).astype(kind)
            own = own.set_column(own.schema.get_field_index(name), name, pa.array(total))
        return own

    out = None
    for k in range(PARTS):
        part = rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(PARTS)) == k).select("doc_id", "text")
        asked = part.mapInArrow(walk, "bucket int, block long, keys binary, docs binary, info binary")
        found = asked.groupBy("bucket").cogroup(model.entries.groupBy("bucket")).applyInArrow(find, "block long, docs binary, sums binary, info binary")
        own = common.materialise(found.groupBy("block").applyInArrow(gather, DOC), outer=True)
        out = own if out is None else out.unionByName(own)
    return out


def score(docs: DataFrame, learn: Column | None = None, share: float = 1e-6, least: int = 2, order: int = 3, discount: float = 0.75) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of what isn't ASCII white space, with A-Z in lower case, and one end per text. learn: the rows to
    learn from. base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) for each token, with c, N and V exact over all
    training texts. n-grams of up to `order` words that occur `least` times are kept. Words with n >= share * N travel
    with the plan and all others are looked up in buckets, which makes no difference to the result. Null texts count as
    empty and train as such; repeated rows and null ids are told apart by their place; other columns are not read. With
    nothing to learn from, N and V are 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("learns") if learn is None else F.coalesce(learn, F.lit(False)).alias("learns"))
    with common.scratch(docs.sparkSession):
        model = Model(rows.where("learns"), share, least, order, discount)
        found = walked(rows, model, order)
    missing = F.col("n_tokens") - F.col("n_known")
    base = F.col("base") + missing * F.lit(float(np.log10(0.5))) - F.col("n_tokens") * F.lit(float(np.log10(model.unseen)))
    return found.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + base).alias("score"))
