"""Similarity join of texts by the Jaccard measure of their word n-grams: a size-aware heavy-light join.

A text is its set of distinct n-grams of words; equal sets are one node. Small sets enumerate their subsets of the size
that a link needs, so linked ones meet in a subset's list. Large sets are posted in inverted lists. What a list
proposes is verified by the sets' intersection, as two larger sets may meet in a list for a larger and a smaller
one. An inverted list stands for the part of a set that falls into one range of a hash: two sets with
at most h differing elements agree in one of h + 1 parts, and parts, unlike single n-grams, are not filled up by
passages that many texts share. The boundary between small and large comes from the costs of both ways on a sample.

No step caps a list. A list proposes its members' links to its most posted one, which among copies is the least
edited; only lists whose members end in different components are looked at again, between these components. Counts
of the sets' elements by ranges of a hash show which nodes may have a link left there; their sets then meet in tiles,
where pairs are verified and merged on the spot, so that no step passes on more links than a list has members.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20  # bytes of text that are hashed at once, but for longer texts
#: Broadcasts of node or row ids stay under so many rows (16 bytes each); above, tables are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of sets that a part of a long list is meant to hold, and ranges whose elements are counted: at least
#: RANGES, and for larger sets so many that about PER_RANGE elements fall into one, up to MOST_RANGES.
PART = 4096
TILE_BYTES = 32_000_000
RANGES, PER_RANGE, MOST_RANGES = 128, 4, 1 << 14
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


LETTERS = mix(np.arange(256, dtype=np.uint64), 77)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, A-Z in lower case, and how many words each text has."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    inside = ~SPACES[data]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    ends = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), sizes
    letters = np.flatnonzero(inside)
    lengths = np.diff(np.searchsorted(letters, starts), append=len(letters))
    place = letters - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), 0xD1342543DE82EF95, dtype=np.uint64))
        sums = np.add.reduceat(LETTERS[data[letters]] * powers[place], np.cumsum(lengths) - lengths)
    return mix(sums), sizes


def shingle_sets(texts: list[bytes], k: int):
    """The sorted distinct hashes of each text's n-grams of k words; the whole sequence where there are fewer words."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        words, sizes = word_hashes(texts[begin:end])
        grams = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
        for i in range(k):
            grams = mix(grams + words[i : len(words) - k + 1 + i], i) if len(grams) else grams
        at = 0
        for n in sizes:
            if n >= k:
                yield np.unique(grams[at : at + n - k + 1])
            elif n:
                whole = np.full(1, n, dtype=np.uint64)
                for w in words[at : at + n]:
                    whole = mix(whole + w, k + 1)
                yield whole
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += n
        begin = end


@dataclass
class Scheme:
    """Which lists a set is posted in, for links from num / den on."""

    num: int
    den: int
    small: int = 0  # sets up to this size enumerate subsets among themselves
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    ways: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # parts of each hot list
    classes: list[int] = field(default_factory=lambda: [1])
    cuts: dict[int, tuple[int, int]] = field(default_factory=dict)

    LEVELS = 3

    def overlap(self, n: int, m: int) -> int:
        """Least intersection of linked sets of sizes n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def class_of(self, n: int) -> int:
        """Sizes fall into classes so wide that linked sets are in the same or in neighbouring ones."""
        while self.classes[-1] <= n:
            self.classes.append(self.classes[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.classes, n, side="right")) - 1

    def parts(self, c: int) -> tuple[int, int]:
        """(parts, how many may be empty) for links of class c with c and c + 1.

        Linked sets differ in h elements at most, so of h + 1 + e parts 1 + e agree, and one of these has
        elements if no more than e parts of one of the sets are empty."""
        if c not in self.cuts:
            self.class_of(self.classes[-1] * 2)
            self.class_of(self.classes[min(c + 2, len(self.classes) - 1)] * 2)
            least, most = self.classes[c], self.classes[c + 1] - 1 + self.classes[c + 2] - 1
            h = most * (self.den - self.num) // (self.num + self.den)
            empty = 0
            for _ in range(3):
                mean = (h + 1 + empty) * np.exp(-least / (h + 1 + empty))
                empty = int(np.ceil(mean + 3 * np.sqrt(mean))) if h else 0
            self.cuts[c] = (h + 1 + empty, empty)
        return self.cuts[c]

    def subset_sizes(self, n: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, subset size) for each partner size among small sets."""
        low, high = -(-n * self.num // self.den), min(self.small, n * self.den // self.num)
        return [(min(n, m), max(n, m), self.overlap(n, m)) for m in range(low, high + 1)]

    def costs(self, n: int) -> tuple[int, int]:
        """(lists by subsets, lists by parts) of a set of size n."""
        light = sum(comb(n, o) for _, _, o in self.subset_sizes(n)) if n <= self.small else 0
        heavy = 0
        if n > self.small or n * self.den // self.num > self.small:
            c = self.class_of(n)
            heavy = sum(min(n, self.parts(x)[0]) for x in ([c - 1, c] if c else [c]))
        return light, heavy

    def lists(self, grams: np.ndarray) -> np.ndarray:
        """Keys of the lists of a set, by subsets and by parts."""
        n, out = len(grams), []
        if not n:
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            if n <= self.small:
                own = mix(grams, 5)
                for a, b, o in self.subset_sizes(n):
                    if o == n == a == b:
                        continue  # equal sets are one node already
                    keys = [own[list(kept)].sum(dtype=np.uint64) for kept in itertools.combinations(range(n), o)]
                    out.append(mix(np.array(keys, dtype=np.uint64), 100 + a * 64 + b))
            if n > self.small or n * self.den // self.num > self.small:
                c = self.class_of(n)
                for x in [c - 1, c] if c else [c]:
                    out.append(self.part_keys(grams, x))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)

    def part_keys(self, grams: np.ndarray, c: int) -> np.ndarray:
        """Keys of the parts of a set for class c. Where too many parts are empty, the next level's follow.

        Level 0 leaves frequent n-grams out, which can only shrink a difference; the next ones take all, by
        other ranges; at the last one, each element is a part."""
        parts, empty = self.parts(c)
        out = []
        rare = grams
        if len(self.frequent):
            rare = grams[self.frequent[np.minimum(np.searchsorted(self.frequent, grams), len(self.frequent) - 1)] != grams]
        for level in range(self.LEVELS):
            x = mix(rare if level == 0 else grams, 10 + level)
            part = ((x >> U(32)) * U(parts) >> U(32)).astype(np.int64)
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, part, x)
            full = np.bincount(part, minlength=parts) > 0
            out.append(mix(sums + U(c * 8 + level) * U(0xA24BAED4963EE407) + np.arange(parts, dtype=np.uint64), 20 + level)[full])
            if parts - full.sum() <= empty:
                return np.concatenate(out)
        out.append(mix(grams + U(c), 30))
        return np.concatenate(out)


def choose_scheme(docs: DataFrame, k: int, num: int, den: int, sample: int = 1024) -> Scheme:
    """Scheme from a sample of about `sample` rows: boundary by cost, frequent n-grams, and lists to deal out.

    Results don't depend on it, only costs do. The sample leaves out texts above a million letters."""
    n = docs.count()
    picked = docs.where((F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(max(1, n // sample))) == 0) & (F.length("text") < 1_000_000)).select("text").limit(2 * sample)

    def sets(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(common.text_bytes(batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["grams"])

    found = [x.values.to_numpy().view(np.uint64) for x in picked.mapInArrow(sets, "grams array<long>").toArrow().column("grams")]
    scheme, best = Scheme(num, den), None
    sizes, counts = np.unique([len(x) for x in found if len(x)], return_counts=True)
    for small in range(0, 25):
        trial = Scheme(num, den, small)
        cost = sum(int(c) * (a + 2 * b) for s, c in zip(sizes, counts, strict=True) if s <= 40 for a, b in [trial.costs(int(s))])
        if best is None or cost < best:
            best, scheme = cost, trial
    if found:
        grams, times = np.unique(np.concatenate(found), return_counts=True)
        scheme.frequent = grams[times >= max(6, len(found) // 200)]
        keys, times = np.unique(np.concatenate([scheme.lists(x) for x in found]), return_counts=True)
        is_hot = times >= max(8, len(found) // 100)
        scheme.hot = keys[is_hot]
        scheme.ways = np.clip(np.ceil(times[is_hot] / len(found) * n / PART), 1, 4096).astype(np.int64)
    return scheme


def node_of(grams: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(grams, 3).sum(dtype=np.uint64) + U(len(grams))], dtype=np.uint64), 4).view(np.int64)[0])


def range_counts(grams: np.ndarray) -> bytes:
    """Elements of a set in each of a power of two of ranges of a hash, at most 255. Sets that differ in d elements differ by d at most in sum."""
    ranges = RANGES
    while ranges * PER_RANGE < len(grams) and ranges < MOST_RANGES:
        ranges *= 2
    part = (mix(grams, 60) >> U(32)) * U(ranges) >> U(32)
    return np.minimum(np.bincount(part.astype(np.int64), minlength=ranges), 255).astype(np.uint8).tobytes()


class Counts:
    """range_counts() of several sets, to be compared in the ranges of the one with fewer."""

    def __init__(self, packed: list[bytes]):
        self.ranges = np.array([len(x) for x in packed])
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # ranges: (row of each set, or -1; counts)
        for ranges in np.unique(self.ranges).tolist():
            own = np.flatnonzero(self.ranges >= ranges)
            held = [np.frombuffer(packed[i], dtype=np.uint8).astype(np.int64).reshape(ranges, -1).sum(axis=1) for i in own]
            row = np.full(len(packed), -1)
            row[own] = np.arange(len(own))
            self.levels[ranges] = row, np.minimum(np.stack(held), 255).astype(np.int16)

    def differ(self, x: int, others: np.ndarray) -> np.ndarray:
        """At most by how many elements set x surely differs from each of the others."""
        out, ranges = np.zeros(len(others), dtype=np.int64), np.minimum(self.ranges[others], self.ranges[x])
        for r in np.unique(ranges).tolist():
            row, held = self.levels[r]
            own = np.flatnonzero(ranges == r)
            out[own] = np.abs(held[row[others[own]]] - held[row[x]]).sum(axis=1)
        return out


def posted(docs: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """(doc_id, h, node, n, counts, lists) of each row, h a hash of its text; a task posts equal sets once."""

    def post(batches):
        done: set[int] = set()
        for batch in batches:
            nodes, sizes, counts, lists = [], [], [], []
            for grams in shingle_sets(common.text_bytes(batch.column("text")), k):
                node = node_of(grams)
                new = node not in done
                if new:
                    if len(done) >= 500_000:
                        done.clear()
                    done.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                counts.append(range_counts(grams) if new else None)
                lists.append(scheme.lists(grams) if new else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "h", "node", "n", "counts", "lists"])
        common.give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return common.materialise(rows.mapInArrow(post, "doc_id long, h long, node long, n long, counts binary, lists array<long>"))


def members(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(at, way, node, n, other, other_n): the nodes of each list that has at least three, and of all lists the sample
    showed to be hot. A list of two nodes is one row, with the second node as `other`, which is null elsewhere.

    Hot lists are dealt out in ways, numbered from 1; others are way 0."""
    hot, ways = scheme.hot, scheme.ways

    def spread(batches):
        for batch in batches:
            at, node, n = (batch.column(c).to_numpy() for c in ("at", "node", "n"))
            way = np.zeros(len(at), dtype=np.int32)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, at), len(hot) - 1)
                is_hot = hot[place] == at
                way[is_hot] = 1 + (mix(node[is_hot].view(np.uint64), 9) % ways[place[is_hot]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(way), pa.array(node), pa.array(n)], names=names[:4])

    def runs(batches):
        last = None  # the last row, which of its list's nodes it is, and the list's first and second node with their sizes
        for batch in batches:
            at, way, node, n = (batch.column(c).to_numpy() for c in names[:4])
            if not len(at):
                continue
            if last is not None:  # it goes in front of the batch
                at, way, node, n = (np.concatenate([[v], x]) for v, x in zip(last[:4], (at, way, node, n), strict=True))
            same = (at[1:] == at[:-1]) & (way[1:] == way[:-1])
            repeat = np.concatenate([[False], same & (node[1:] == node[:-1])])
            begin = np.concatenate([[True], ~same])
            which = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            first, first_n = node[which], n[which]
            order = np.cumsum(~repeat)
            nth = order - order[which]  # distinct nodes of a list, counted from its begin
            if last is not None:
                own = which == 0
                nth, first, first_n = np.where(own, nth + last[4], nth), np.where(own, last[5], first), np.where(own, last[6], first_n)
            new = ~repeat
            if last is not None:
                new[0] = False
            number, next_ = np.cumsum(begin) - 1, np.flatnonzero(new & (nth == 1))
            second, second_n = np.zeros(number[-1] + 1, dtype=np.int64), np.zeros(number[-1] + 1, dtype=np.int64)
            if last is not None:
                second[0], second_n[0] = last[7:]
            second[number[next_]], second_n[number[next_]] = node[next_], n[next_]
            second, second_n = second[number], second_n[number]
            third = np.flatnonzero(new & (nth == 2) & (way == 0))  # now the first two are known to be in company
            live = np.flatnonzero(new & ((nth > 1) | (way > 0)))
            two = np.flatnonzero(np.append(begin[1:], False) & (nth == 1) & (way == 0))  # lists that end with their second node
            columns = [np.concatenate([x[third], x[third], x[live], x[two]]) for x in (at, way)]
            columns += [np.concatenate([first[third], second[third], node[live], first[two]]), np.concatenate([first_n[third], second_n[third], n[live], first_n[two]])]
            alone = np.arange(len(columns[0])) < len(columns[0]) - len(two)
            columns += [np.concatenate([np.zeros(alone.sum(), dtype=np.int64), x[two]]) for x in (second, second_n)]
            if len(alone):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:4]] + [pa.array(c, mask=alone) for c in columns[4:]], names=names)
            last = (at[-1], way[-1], node[-1], n[-1], nth[-1], first[-1], first_n[-1], second[-1], second_n[-1])
        if last is not None and last[4] == 1 and last[1] == 0:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last[:2], *last[5:])], names=names)

    names = ["at", "way", "node", "n", "other", "other_n"]
    schema = "at long, way int, node long, n long"
    each = rows.where("n > 0").select(F.explode("lists").alias("at"), "node", "n").mapInArrow(spread, schema)
    each = each.repartition("at", "way").sortWithinPartitions("at", "way", "node")
    return common.materialise(each.mapInArrow(runs, f"{schema}, other long, other_n long"))


def few(frame: DataFrame) -> DataFrame:
    """A written table of ids to be joined where the rows are, if BROADCAST_ROWS allow it."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def most_posted(lists: DataFrame, twos: DataFrame) -> DataFrame:
    """(at, rep, rep_n): the node of each list that is posted in most of all lists and twos (ties: the larger).

    Sums by list and node combine within tasks, and what they are joined with is written before, so that a
    list or node with many rows can be split."""
    every = lists.select("node").unionByName(twos.select(F.explode(F.array("node", "other")).alias("node")))
    posts = common.materialise(every.groupBy("node").agg(F.count(F.lit(1)).alias("posts")))
    best = lists.join(few(posts), "node").groupBy("at").agg(F.max(F.struct("posts", "node", "n")).alias("best"))
    return common.materialise(best.select("at", F.col("best.node").alias("rep"), F.col("best.n").alias("rep_n")))


def tiled(rows: DataFrame, weight: Column, room: int, more: DataFrame) -> DataFrame:
    """rows (at, node, ...) dealt into tiles (at, i, j) of two parts of their list, with `way`, the part of a row, and
    with the columns of more, which is by node.

    A list's parts come from the exact sum of its rows' weights, about `room` each. Any two rows of a list meet in a
    tile, and rows of one part meet in that of i = j only. What a node carries joins last, as it is wide."""
    sums = rows.groupBy("at").agg(F.ceil(F.sum(weight) / room).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(common.materialise(sums), "at", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("way", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("way", "with"), "j": F.greatest("way", "with")}).drop("with", "parts").join(more, "node")
    return rows.repartition("at", "i", "j").sortWithinPartitions("at", "i", "j")


def by_tile(rows: DataFrame, judge, schema: str) -> DataFrame:
    """What judge(table of one tile) yields, over rows that tiled() has dealt."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            now = np.stack([table.column(c).to_numpy() for c in ("at", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((now[:, 1:] != now[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
            done = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last tile may go on in the next batch
            for a, b in itertools.pairwise(cuts[: done + 1]):
                yield from judge(table.slice(a, b - a))
            held = None if batch is None else table.slice(cuts[done])
        common.give_back()

    return rows.mapInArrow(run, schema)


class Tile:
    """The rows of one tile, and for each of them which others it may still be linked with."""

    def __init__(self, table: pa.Table, scheme: Scheme):
        self.way, self.node, self.n, self.root, i, j = (table.column(c).to_numpy() for c in ("way", "node", "n", "root", "i", "j"))
        self.crossing = i[0] != j[0]
        roots, self.of, self.sizes = np.unique(self.root, return_inverse=True, return_counts=True)
        self.num, self.den = scheme.num, scheme.den

    def parted(self) -> bool:
        return len(self.sizes) > 1

    def pairs(self, counts: Counts):
        """(x, others): each pair of different components once, the largest one's rows never first, that sizes and
        counts by ranges allow to be linked. Components may be merged in `of` between two steps."""
        large = self.of == self.sizes.argmax()
        place = np.arange(len(self.of))
        for x in np.flatnonzero(~large):
            other = (self.of != self.of[x]) & (large | (place > x))
            other &= np.maximum(self.n, self.n[x]) * self.num <= np.minimum(self.n, self.n[x]) * self.den
            if self.crossing:
                other &= self.way != self.way[x]
            other = np.flatnonzero(other)
            differ = self.n[other] + self.n[x] + 2 * (-(self.num * (self.n[other] + self.n[x])) // (self.num + self.den))
            other = other[counts.differ(x, other) <= differ]
            if len(other):
                yield x, other


#: Of a node's torn lists, so many of the smallest keys travel with it.
KEYS = 24


def open_nodes(torn: DataFrame, own: DataFrame, scheme: Scheme) -> DataFrame:
    """(at, node) of those rows of torn lists (at, node, n, root, rep) that may be linked with one of another component.

    own: (node, counts, keys). A pair that also meets in a list of a smaller key, by the keys both carry, is left to that list, and pairs with
    the list's rep are known already."""

    def judge(table):
        tile = Tile(table, scheme)
        if not tile.parted():
            return
        at, rep = table.column("at")[0].as_py(), table.column("rep")[0].as_py()
        counts = Counts(table.column("counts").to_pylist())
        column = table.column("keys").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, ends = column.flatten().to_numpy(), column.value_lengths().to_numpy().cumsum()
        begins = np.concatenate([[0], ends[:-1]])
        live = np.zeros(len(tile.node), dtype=bool)
        for x, other in tile.pairs(counts):
            if tile.node[x] == rep:
                continue
            other = other[tile.node[other] != rep]
            own = flat[begins[x] : ends[x]]
            own = own[own < at]
            if len(own) and len(other):
                sizes = ends[other] - begins[other]
                index = np.repeat(begins[other] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                hit = own[np.minimum(np.searchsorted(own, flat[index]), len(own) - 1)] == flat[index]
                other = other[np.bincount(np.repeat(np.arange(len(other)), sizes), weights=hit, minlength=len(other)) == 0]
            if len(other):
                live[x] = True
                live[other] = True
        if live.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(live.sum(), at)), pa.array(tile.node[live])], names=["at", "node"])

    return by_tile(tiled(torn, F.greatest(F.col("n") / PER_RANGE, F.lit(4 * RANGES)), PART * 4 * RANGES, own), judge, "at long, node long").distinct()


def links_within(rows: DataFrame, held: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links that join components within tiles of rows (at, node, n, root), by exact intersections.

    held: (node, grams).
    A tile's components are merged as links are found, so it returns fewer links than it has rows."""

    def judge(table):
        tile = Tile(table, scheme)
        if not tile.parted():
            return
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("grams")]
        counts = Counts([range_counts(s) for s in sets])
        a, b = [], []
        for x, other in tile.pairs(counts):
            own = sets[x]
            for y in other:
                if tile.of[y] == tile.of[x]:
                    continue
                least = scheme.overlap(len(own), len(sets[y]))
                both = (own[np.minimum(np.searchsorted(own, sets[y]), len(own) - 1)] == sets[y]).sum()
                if both >= least:
                    a.append(tile.node[x])
                    b.append(tile.node[y])
                    tile.of[tile.of == tile.of[x]] = tile.of[y]
        if a:
            a, b = np.array(a), np.array(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return by_tile(tiled(rows, F.col("n") * 8 + 64, TILE_BYTES, held), judge, "a long, b long").distinct()


def between_components(lists: DataFrame, best: DataFrame, parts: DataFrame, docs: DataFrame, rows: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """(a, b): links between different components of one list, enough to join all components that lists can join.

    Lists whose nodes but the rep are in one component are done. In the others, two passes over tiles find which
    nodes may have a link left, by sizes and counts, and then, with these nodes' sets, the links."""
    rooted = common.materialise(lists.join(parts, "node", "left").select("at", "node", "n", F.coalesce("root", "node").alias("root")))
    # Of lists with the same nodes, told apart by two hashes of them all, one is enough.
    same = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"s{i}") for i in range(2)]
    torn = rooted.groupBy("at").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("m"), *same).where("x <> y AND m > 2")
    torn = torn.groupBy("m", "s0", "s1").agg(F.min("at").alias("at"))
    torn = few(common.materialise(torn.select("at")))
    torn_rows = common.materialise(rooted.join(torn, "at").join(best.select("at", "rep").join(torn, "at"), "at"))
    others = F.when(F.col("node") != F.col("rep"), F.col("root"))
    done = torn_rows.groupBy("at").agg(F.min(others).alias("x"), F.max(others).alias("y")).where("x = y").select("at")
    torn_rows = common.materialise(torn_rows.join(common.materialise(done), "at", "left_anti"))
    counts = rows.where(F.col("counts").isNotNull()).select("node", "counts").dropDuplicates(["node"])
    live = torn_rows
    for _ in range(2):  # a node's smallest lists tell more, the fewer lists are open
        keys = live.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("at")), 1, KEYS).alias("keys"))  # a node's own lists
        own = common.materialise(keys.join(counts, "node"))
        live = common.materialise(torn_rows.join(open_nodes(live, own, scheme), ["at", "node"]))
    if live.isEmpty():
        return live.select(F.col("at").alias("a"), F.col("node").alias("b"))
    held = sets_of(live.select("node").distinct(), docs, rows, k)
    return common.materialise(links_within(live.select("at", "node", "n", "root"), held, scheme))


def compatible(scheme: Scheme, a: str, b: str) -> Column:
    return F.greatest(a, b) * scheme.num <= F.least(a, b) * scheme.den


def sets_of(nodes: DataFrame, docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(node, grams) of distinct nodes, from one text of each."""
    one = rows.join(common.materialise(nodes), "node").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("x")).select(F.col("x.doc_id").alias("_d"), F.col("x.h").alias("_h"))
    one = common.materialise(one.distinct())
    wanted = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one

    def sets(batches):
        for batch in batches:
            found = list(shingle_sets(common.text_bytes(batch.column("text")), k))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(g) for g in found], pa.int64()), pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))], names=["node", "grams"])
        common.give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))).select("text")
    found = common.materialise(texts.mapInArrow(sets, "node long, grams array<long>"))
    # Repeated rows bring equal sets; a node needs one. Sets are wide, so they only move if there are such rows.
    return found if found.count() == one.count() else common.materialise(found.dropDuplicates(["node"]))


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose sets are linked, by their exact intersection."""
    held = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, rows, k)
    left = held.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = held.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common_grams = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common_grams
    return common.materialise(both.where(common_grams * scheme.den >= union * scheme.num).select("a", "b"))


def ordered(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Texts link when the Jaccard measure of their sets of k-word n-grams (words: runs of what isn't ASCII white
    space, A-Z in lower case; all words where there are fewer than k) is num / den or more. component_id is the
    smallest doc_id that links reach. Texts that are null or without words are empty and link with nothing.
    Rows that share an id are told apart by their texts; rows without an id take part, but have no component of
    their own. Further columns are not read. N-grams, sets and lists are told apart by 64-bit hashes."""
    with common.scratch(docs.sparkSession):
        out = grouped(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        return common.materialise(out, outer=True)


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row of docs: doc_id, h (a hash of its text), n, root (a number of its component; null for an empty set) and
    component, its smallest doc_id."""
    scheme = choose_scheme(docs, k, num, den)
    rows = posted(docs, k, scheme)
    every = members(rows, scheme)
    lists, twos = every.where("other IS NULL").select("at", "way", "node", "n"), every.where("other IS NOT NULL").select("node", "n", "other", "other_n")
    nodes = common.materialise(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep_doc")))
    best = most_posted(lists, twos)
    met = lists.join(best, "at").select("node", "n", "rep", "rep_n").unionAll(twos)  # a list of two proposes them
    first = common.materialise(ordered(met.where(compatible(scheme, "n", "rep_n")), "node", "rep"))
    links = verified(first, docs, rows, k, scheme)
    parts = common.connected_components(links)
    more = between_components(lists, best, parts, docs, rows, k, scheme)
    if not more.isEmpty():
        parts = common.connected_components(links.unionByName(more))
    least = common.materialise(parts.join(nodes, "node").groupBy("root").agg(F.min("rep_doc").alias("component")))
    named = parts.join(least, "root").select("node", "root", "component")
    named = nodes.join(named, "node", "left").select(F.col("node").alias("_n"), F.coalesce("root", "node").alias("root"), F.coalesce("component", "rep_doc").alias("component"))
    out = rows.select("doc_id", "h", "node", "n").join(common.materialise(named), (F.col("node") == F.col("_n")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "h", "n", "root", "component")


def keep_one(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs, all columns of any name: of each group of near copies, one row, and all rows without words.

    The row of the smallest id stays (null last), of several the one whose text has the smallest hash, and of equal
    ones the first by all their columns as JSON."""
    with common.scratch(docs.sparkSession):
        found = common.materialise(grouped(docs.select("doc_id", "text"), k, num, den).where("n > 0").select(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h").alias("x"), "root"))
        stay = common.materialise(found.groupBy("root").agg(F.min("x").alias("s")))
        each = found.groupBy("root", "x").agg(F.count(F.lit(1)).alias("times")).join(stay, "root")
        # A row that isn't the one to stay, or the one to stay where it is repeated.
        over = each.where((F.col("x") != F.col("s")) | (F.col("times") > 1))
        over = common.materialise(over.select(F.col("x.doc_id").alias("d"), F.col("x.h").alias("h"), (F.col("x") == F.col("s")).alias("again")).distinct(), outer=True)
    rows = docs.select(common.packed(docs).alias("_doc"))
    listed = F.broadcast(over) if over.count() <= BROADCAST_ROWS else over
    met = rows.join(listed, F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("_doc.text") == F.col("h")), "left")
    kept = met.where("again IS NULL").select("_doc.*")
    if over.where("again").isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("d", "h").orderBy(F.to_json("_doc")))
    return kept.unionByName(met.where("again").withColumn("_i", first).where("_i = 1").select("_doc.*"))
