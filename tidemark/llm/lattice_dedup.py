"""Near-duplicate embeddings by lattice hashing.

Several tables each project vectors at random to eight dimensions and decode them to the nearest point of the E8
lattice. A vector stands in its own cell and also probes the neighbouring cells it lies nearest to; vectors that meet
are verified by their cosine. Which cells hold more than one vector is found out with ids alone; only there do the
vectors themselves go. Equal vectors are one representative with a multiplicity, crowded cells are cut into tiles of
bounded size, and a pair that meets several times counts at its first meeting only.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a cell that are compared in one block; more are cut into tiles of two such parts each.
PART = 1024


def shortest_vectors() -> np.ndarray:
    """The 240 neighbours of the origin in E8."""
    whole = [[a if k == i else b if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, dtype=np.float64)


def even_point(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: an odd one moves the coordinate that was rounded farthest."""
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    worst = np.abs(d[odd]).argmax(axis=1)
    f[odd, worst] += np.where(d[odd, worst] >= 0, 1, -1)
    return f


def lattice_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer points and the same shifted by one half."""
    a, b = even_point(x), even_point(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T with sums in one order whatever the number of rows, so that cells come out alike everywhere."""
    return (x[:, None, :] * y[None, :, :]).sum(axis=2)


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Random projections for one dimension of vectors; cells() gives the keys of home and probed cells."""

    def __init__(self, dim: int, tables: int, probes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.project = rng.normal(size=(tables, 8, dim)) * (2 / width)
        self.shift = rng.uniform(0, 2, size=(tables, 8))
        self.probes, self.near = probes, shortest_vectors()
        self.mix = rng.integers(1, 1 << 62, size=8, dtype=np.int64) | 1

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        """Keys [row, 1 + probes] in table t; the first is the home cell. The lowest four bits are the table's number."""
        out = np.empty((len(x), 1 + self.probes), dtype=np.int64)
        for i in range(0, len(x), 512):
            y = dots(x[i : i + 512], self.project[t]) + self.shift[t]
            home = lattice_point(y)
            order = np.argpartition(-dots(y - home, self.near), self.probes - 1, axis=1)[:, : self.probes] if self.probes else np.zeros((len(y), 0), dtype=np.int64)
            points = np.concatenate([home[:, None, :], home[:, None, :] + self.near[order]], axis=1)
            out[i : i + 512] = ((points * 2).astype(np.int64) * self.mix).sum(axis=2) & ~np.int64(15) | t
        return out


def vectors_of(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each length of vector in an Arrow list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return [(rows := np.flatnonzero(sizes == n), flat[begins[rows][:, None] + np.arange(n)]) for n in np.unique(sizes)]


def usable(column: str = "embedding") -> Column:
    """Not null, some component other than 0, none of them null, NaN or infinite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, ok) & F.exists(column, lambda x: x != 0), F.lit(False))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def cell_keys(cells: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys of the cells of several groups of vectors; the number of the table stays."""
    mixed = scrambled(cells.view(np.uint64) + scrambled(group.view(np.uint64))[:, None])
    return (mixed & ~np.uint64(15) | (cells.view(np.uint64) & np.uint64(15))).view(np.int64)


def met(reps: DataFrame, tables: int, probes: int, width: float, seed: int, sample: int = 4096) -> DataFrame:
    """(k, rep, home) of representatives (group, dim, rep, embedding): the cells in which a vector at home meets another one.

    Ids alone go by their cell's bucket, packed; the many cells that a single vector visits end there. Cells that a
    sample of vectors shows to be crowded skip that step, so that a bucket stays small; they are cut into tiles later."""
    spark = reps.sparkSession
    size = reps.count()
    buckets = max(2 * spark.sparkContext.defaultParallelism, size // 20_000)
    rate = min(1.0, sample / max(size, 1))
    picked = reps.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 20)) < rate * (1 << 20)).select("group", "embedding").limit(2 * sample)

    def homes(batches):
        made: dict[int, Tables] = {}
        for batch in batches:
            for rows, x in vectors_of(batch.column("embedding")):
                own = made.setdefault(x.shape[1], Tables(x.shape[1], tables, probes, width, seed))
                group = batch.column("group").to_numpy()[rows]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(cell_keys(own.cells(directions(x), t), group).ravel())], names=["k"])

    keys, times = np.unique(picked.mapInArrow(homes, "k long").toArrow().column("k").to_numpy(), return_counts=True)
    crowded = keys[times >= max(8, rate * size / 200)]  # at most 200 * tables * (1 + probes)

    def deal(batches):
        made: dict[int, Tables] = {}
        for batch in batches:
            for rows, x in vectors_of(batch.column("embedding")):
                own, x = made.setdefault(x.shape[1], Tables(x.shape[1], tables, probes, width, seed)), directions(x)
                group, rep = (batch.column(c).to_numpy()[rows] for c in ("group", "rep"))
                k = np.concatenate([cell_keys(own.cells(x, t), group) for t in range(tables)], axis=1)
                home = np.zeros(k.shape, dtype=np.uint8)
                home[:, :: 1 + probes] = 1
                k, home, rep = k.ravel(), home.ravel(), np.repeat(rep, k.shape[1])
                bucket = ((k.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                if len(crowded):
                    bucket[crowded[np.minimum(np.searchsorted(crowded, k), len(crowded) - 1)] == k] = -1
                by = np.argsort(bucket, kind="stable")
                there, begins = np.unique(bucket[by], return_index=True)
                cut = [*begins.tolist(), len(by)]
                parts = [pa.array([a[cut[i] : cut[i + 1]].tobytes() for i in range(len(there))], pa.binary()) for a in (k[by], rep[by], home[by])]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *parts], names=["bucket", "k", "rep", "home"])

    def rows_of(table, keep):
        k, rep, home = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("k", np.int64), ("rep", np.int64), ("home", np.uint8)))
        live = keep(k, home) if keep else np.ones(len(k), dtype=bool)
        return pa.table({"k": k[live], "rep": rep[live], "home": home[live].astype(bool)})

    def in_company(k, home):
        _, at, n = np.unique(k, return_inverse=True, return_counts=True)
        return ((n > 1) & (np.bincount(at, weights=home, minlength=len(n)) > 0))[at]

    def unpack(batches):
        for batch in batches:
            yield from rows_of(pa.Table.from_batches([batch]), None).to_batches()

    sent = common.materialise(reps.select("group", "rep", "embedding").mapInArrow(deal, "bucket int, k binary, rep binary, home binary"))
    schema = "k long, rep long, home boolean"
    seldom = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda table: rows_of(table, in_company), schema)
    return common.materialise(seldom.unionByName(sent.where("bucket < 0").mapInArrow(unpack, schema)))


def near_links(reps: DataFrame, threshold: float, tables: int, probes: int, width: float, seed: int) -> DataFrame:
    """(rep, n, other) of representatives (group, dim, rep, m, embedding): parts of a representative's links,
    weighted by multiplicity, and a neighbour in the same block's spanning forest (or null)."""
    live = met(reps, tables, probes, width, seed)
    sizes = live.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sizes = common.materialise(sizes.where(F.col("n") > PART).select("k", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    dealt = live.join(sizes, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.join(reps.select("rep", "dim", "m", "embedding"), "rep")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["k", "dim", "i", "j"]
    dealt = dealt.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")})
    dealt = dealt.select(*key, "part", "home", "rep", "m", "embedding")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)

    def compare(batches):
        made: dict[int, Tables] = {}
        held = None
        for batch in itertools.chain(batches, [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks()
            # Rows of a group are neighbours; groups are told apart by all parts of their key.
            change = np.zeros(table.num_rows, dtype=bool)
            for name in key:
                codes = table.column(name).combine_chunks().dictionary_encode()
                codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])
            if batch is not None:
                held = table.slice(cuts[-2])
                table, cuts = table.slice(0, cuts[-2]), cuts[:-1]
            found = list(blocks(table, cuts, made))
            if found:
                rep, n, other = map(np.concatenate, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.array(other, pa.int64(), mask=other == rep)], names=["rep", "n", "other"])

    def blocks(table, cuts, made):
        sizes = np.diff(cuts)
        if not len(sizes):
            return
        column = table.column("embedding").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        dims, ks, parts, homes, reps_, ms, js, is_ = (table.column(c).to_numpy() for c in ("dim", "k", "part", "home", "rep", "m", "j", "i"))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        begins = column.offsets.to_numpy() - column.offsets[0].as_py()
        for g in np.flatnonzero(sizes > 1):
            a, b = cuts[g], cuts[g + 1]
            home = homes[a:b]
            if not home.any():
                continue
            x = directions(flat[begins[a] : begins[b]].reshape(b - a, dims[a]).astype(np.float64))
            h = np.flatnonzero(home)
            meet = x[h] @ x.T >= threshold - 1e-9
            meet &= reps_[a:b][h][:, None] != reps_[a:b][None, :]
            meet[:, h] &= h[:, None] < h[None, :]  # two homes meet once
            if is_[a] != js[a]:
                meet &= parts[a:b][h][:, None] != parts[a:b][None, :]
            p, q = np.nonzero(meet)
            if not len(p):
                continue
            p = h[p]
            sure = (x[p] * x[q]).sum(axis=1) >= threshold
            p, q = p[sure], q[sure]
            if not len(p):
                continue
            first = is_first(x, p, q, home, reps_[a:b], ks[a] & 15, made.setdefault(dims[a], Tables(dims[a], tables, probes, width, seed)))
            p, q = p[first], q[first]
            n = np.zeros(b - a, dtype=np.int64)
            np.add.at(n, p, ms[a:b][q])
            np.add.at(n, q, ms[a:b][p])
            yield reps_[a:b][n > 0], n[n > 0], forest(p, q, reps_[a:b])[n > 0]

    def is_first(x, p, q, home, ids, t, own):
        """Whether pairs p, q (p at home) didn't meet before: in an earlier table, or in this one at a home that comes first."""
        used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        i, j = at[: len(p)], at[len(p) :]
        seen = np.zeros(len(p), dtype=bool)
        for k in range(t + 1):
            cells = own.cells(x[used], k)
            p_home, q_home = cells[i, 0], cells[j, 0]
            q_visits = (cells[j, 1:] == p_home[:, None]).any(axis=1)
            p_visits = (cells[i, 1:] == q_home[:, None]).any(axis=1)
            if k < t:
                seen |= (p_home == q_home) | q_visits | p_visits
            else:  # here both are at home, or q visits p's home; a visit to the home of the smaller id comes first
                seen |= ~home[q] & ((p_home == q_home) | (p_visits & (ids[q] < ids[p])))
        return ~seen

    def forest(p, q, ids):
        """The smallest id that each row reaches by the pairs of this block."""
        root = ids.copy()
        while True:
            low = np.minimum(root[p], root[q])
            before = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            if (root == before).all():
                return root

    return dealt.mapInArrow(compare, "rep long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = 5, probes: int = 6, width: float = 3.0, seed: int = 3) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors have one length and their cosine reaches
    threshold. Vectors that are null or zero or hold null or non-finite components link with nothing; nor do rows
    without an id. Rows that share an id are one node; each repeated row counts as a vector. With these tables a
    pair at cosine 0.93 is found with a probability above 0.999."""
    with common.scratch(vectors.sparkSession):
        return _near_duplicates(vectors, threshold, tables, probes, width, seed)


def _near_duplicates(vectors: DataFrame, threshold: float, tables: int, probes: int, width: float, seed: int) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fit = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("_use", F.when(fit, F.col("embedding")))
    reps = rows.where(F.col("_use").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    reps = common.materialise(reps.withColumns({"dim": F.size("embedding"), "group": F.xxhash64("label", F.size("embedding"))}))
    found = common.materialise(near_links(reps, threshold, tables, probes, width, seed))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = common.connected_components(found.where(F.col("other").isNotNull()), "rep", "other")
    named = reps.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(
        F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    )
    named = common.materialise(named)
    out = rows.join(named, (F.col("label") == F.col("_l")) & (F.col("_use") == F.col("_e")), "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
    return common.materialise(out, outer=True)
