"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots. Index shards of bounded size hold an inverted file per
pivot: which vectors have it among their nearest, and at which place. A query walks the lists of its own pivots,
which ranks the shard's vectors by footrule distance between the orders; the nearest share of each shard is then
ranked by exact cosine.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, lattice_dedup

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def footrule_gains(perms: np.ndarray, wanted: np.ndarray, pivots: int) -> np.ndarray:
    """[query, vector]: how much nearer than orders without a common pivot they are, by footrule distance / 2.

    perms, wanted: nearest pivots of vectors and queries, in order. With absent pivots at place m, a pivot at
    places r and s takes (m - r) + (m - s) - |r - s| = 2 (m - max(r, s)) off the distance."""
    m = perms.shape[1]
    gains = np.zeros((len(wanted), len(perms)), dtype=np.int16)

    def lists(orders):  # the inverted file: rows and places of each pivot
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by], np.arange(pivots + 1))
        return [(by[a:b] // m, by[a:b] % m) for a, b in itertools.pairwise(ends)]

    for (rows, places), (asking, at) in zip(lists(perms), lists(wanted), strict=True):
        if len(rows) and len(asking):
            gains[np.ix_(asking, rows)] += m - np.maximum(at[:, None], places[None, :])
    return gains


def spread_out(x: np.ndarray, n: int, apart: float = 0.7) -> np.ndarray:
    """Up to n of the directions x in order, leaving out those within cosine `apart` of one that was taken."""
    taken: list[int] = []
    for i in range(len(x)):
        if len(taken) < n and not (taken and (x[taken] @ x[i]).max() > apart):
            taken.append(i)
    return x[taken]


class Index:
    """A permutation index over vectors: `rows` (dim, shard, ids, embedding, perm) and the pivots of each dim.

    Equal vectors share a row with their smallest ids (as many as a search may return, and one more)."""

    def __init__(self, vectors: DataFrame, k: int = 5, pivots: int = 256, sample: int = 2048, places: int = 80, shard_rows: int = 512):
        """sample: the documented bound of the rows that pivots are picked from; all vectors are indexed."""
        self.k = k
        good = vectors.where(lattice_dedup.usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
        rows = good.withColumn("_n", first).where(F.col("_n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        rows = common.materialise(rows.withColumns({"dim": F.size("embedding"), "h": F.xxhash64("embedding")}))
        rank = F.row_number().over(Window.partitionBy("dim").orderBy("h", "embedding"))
        picked = rows.select("dim", "h", "embedding").withColumn("n", rank).where(F.col("n") <= sample).orderBy("dim", "n").collect()
        by_dim = {d: np.array([r["embedding"] for r in g], dtype=np.float64) for d, g in itertools.groupby(picked, lambda r: r["dim"])}
        self.pivots = {d: spread_out(lattice_dedup.directions(x), pivots) for d, x in by_dim.items()}
        counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
        sized = rows.join(F.broadcast(counts), "dim")  # one row per length of vector
        sized = sized.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")).withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))
        self.shards = sized.select("dim", "shards").distinct()
        self.rows = common.materialise(self.with_orders(sized.select("dim", "shard", "ids", "embedding"), places))
        self.places = places

    def with_orders(self, rows: DataFrame, places: int) -> DataFrame:
        """rows and `perm`, the places nearest pivots of `embedding` in order."""
        pivots = self.pivots

        def order(batches):
            for batch in batches:
                perm: list = [None] * batch.num_rows
                for at, x in lattice_dedup.vectors_of(batch.column("embedding")):
                    near = lattice_dedup.directions(x) @ pivots[x.shape[1]].T
                    for i, p in zip(at, np.argsort(-near, axis=1, kind="stable")[:, :places].astype(np.int16), strict=True):
                        perm[i] = p
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perm, pa.list_(pa.int16()))], names=[*batch.schema.names, "perm"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(order, f"{schema}, perm array<smallint>")

    def search(self, queries: DataFrame, share: float = 0.15, least: int = 32, block: int = 1024) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found for each row of queries (vec_id, embedding).

        share, least: how many of a shard's vectors, nearest by footrule, are ranked by cosine. A query's own id is
        never returned; queries that are null, zero or hold null or non-finite components, or that have no id,
        return nothing, and a repeated query counts once. Ties go to the smaller vec_id. Each block of queries meets
        each shard once; a shard returns the ids of k + 1 vectors per query."""
        k, pivots, places = self.k, {d: len(p) for d, p in self.pivots.items()}, self.places
        asked = queries.where(lattice_dedup.usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct()
        asked = asked.withColumn("dim", F.size("embedding")).where(F.col("dim").isin(*self.pivots)) if self.pivots else asked.withColumn("dim", F.size("embedding"))
        asked = common.materialise(self.with_orders(asked, places))
        blocks = max(1, -(-asked.count() // block))
        to = F.broadcast(self.shards.withColumnRenamed("dim", "_dim"))  # one row per length of vector
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        asked = asked.join(to, F.col("dim") == F.col("_dim")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        asked = asked.select("dim", "shard", "block", F.lit(True).alias("asks"), F.array("vec_id").alias("ids"), "embedding", "perm")
        held = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "shard", "block", F.lit(False).alias("asks"), "ids", "embedding", "perm")
        key = ["dim", "shard", "block"]
        both = held.unionByName(asked).repartition(*key).sortWithinPartitions(*key)

        def answer(table: pa.Table, dim: int):
            asks = table.column("asks").to_numpy()
            own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(own) or not len(others):
                return
            flat = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("embedding", "perm", "ids")}
            x = flat["embedding"].reshape(len(asks), dim).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            perm = flat["perm"].reshape(len(asks), -1)
            sizes = table.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            first = flat["ids"][begins]
            take = min(len(others), max(least, int(np.ceil(share * len(others)))))
            for i in range(0, len(own), 128):
                mine = own[i : i + 128]
                gains = footrule_gains(perm[others], perm[mine], pivots[dim])
                near = others[np.argpartition(-gains, take - 1, axis=1)[:, :take]]
                scores = (x[near] * x[mine][:, None, :]).sum(axis=2) / (norm[near] * norm[mine][:, None])
                # Vectors that tie come by their smallest id, so those left out have no smaller one.
                best = np.lexsort((first[near], -scores), axis=1)[:, : k + 1]
                rows, scores = np.take_along_axis(near, best, axis=1), np.take_along_axis(scores, best, axis=1)
                many = sizes[rows].ravel()
                at = np.repeat(begins[rows].ravel() - (np.cumsum(many) - many), many) + np.arange(many.sum())
                query = np.repeat(np.repeat(first[mine], rows.shape[1]), many)
                found, score = flat["ids"][at], np.repeat(scores.ravel(), many)
                other = found != query
                yield pa.RecordBatch.from_arrays([pa.array(query[other]), pa.array(found[other]), pa.array(score[other])], names=["query_id", "vec_id", "score"])

        def search(batches):
            held = None
            for batch in itertools.chain(batches, [None]):
                table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if table is None or not table.num_rows:
                    continue
                now = np.stack([table.column(c).to_numpy() for c in key])
                cuts = np.concatenate([[0], np.flatnonzero((now[:, 1:] != now[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
                done = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last group may go on in the next batch
                for a, b in itertools.pairwise(cuts[: done + 1]):
                    yield from answer(table.slice(a, b - a).combine_chunks(), int(now[0, a]))
                held = None if batch is None else table.slice(cuts[done]).combine_chunks()

        found = both.mapInArrow(search, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
