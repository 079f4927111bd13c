"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame expressions only.

Each source's rows fall by hash into blocks, about as many as the square root of its rows, so that neither the
blocks of a source nor the rows of a block grow large. The mix takes a source's blocks in hash order, over as
many copies as its target needs; the last block is cut between rows, and the last row between words. A binary tree
over output shards splits the vector of block quotas: at each node the left half gets a draw from the multivariate
hypergeometric law. Shards then take disjoint stretches of each source's permuted blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Tables with a row per block, or per row of the blocks that are cut, are broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def near(frame: DataFrame) -> DataFrame:
    """A written table to be joined where the rows are, unless it is large, so that texts don't move."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """_doc, a struct of docs' columns, with _size (words of the text, null: 0) and _h, the hash that orders rows."""
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select(common.packed(docs).alias("_doc"), words.alias("_size"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_h"))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: source, source_size, n, target and the number of its blocks.

    Sources by code point, null last, weigh WEIGHTS in turn. Raising a common level until the capped targets use
    up all sizes has a closed form: in order of cap / weight, sources are capped as long as the level that the
    rest would get is above theirs. The windows hold one row per source."""
    per = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(MOST_COPIES)))
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumns({"level": left / open_weight, "place": F.row_number().over(by_level)})
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    per = per.withColumn("capped", capped)
    # The level that holds is that of the first source that isn't capped.
    level = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(every)["level"]
    per = per.withColumn("target", F.when(F.col("capped") | level.isNull(), F.col("cap")).otherwise(level * F.col("weight")))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt("n"))))
    return per.select("source", "source_size", "n", "target", blocks.cast("long").alias("blocks"))


def block_of(blocks: Column) -> Column:
    """Blocks are stretches of the hash, which is random, so their order by number is a permutation of the rows."""
    return (F.shiftrightunsigned(F.col("_h"), 33) * blocks / F.lit(1 << 31)).cast("long")


def block_plan(rows: DataFrame) -> DataFrame:
    """(_s, _b, times, room) of each block of rows (which have _src, _block, source_size and target).

    All rows are taken target // source_size times, then blocks in order until the target is met. times: how
    often the block is taken whole; room: how many words of it are taken once more, null where none are."""
    per_block = rows.groupBy("_src", "_block").agg(F.sum("_size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    goal = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    running = Window.partitionBy("_src").orderBy("_block")
    per_block = per_block.withColumn("copies", copies).withColumn("rest", goal - copies * F.col("source_size")).withColumn("ends", F.sum("size").over(running))
    begins = F.col("ends") - F.col("size")
    room = F.when((begins < F.col("rest")) & (F.col("rest") < F.col("ends")), F.col("rest") - begins)
    times = F.col("copies") + (F.col("ends") <= F.col("rest")).cast("long")
    return per_block.select(F.col("_src").alias("_s"), F.col("_block").alias("_b"), times.alias("times"), room.alias("room"))


def place(blocks: DataFrame, levels: int, seed: int) -> DataFrame:
    """blocks with `at`, the shards of each block's copies in order, as the splitting tree deals them.

    Within a source, copies are permuted (first copies first); a shard's quota is a stretch of that order."""
    blocks = common.materialise(blocks)
    copies = blocks.withColumn("n", F.col("times") + F.col("room").isNotNull().cast("long")).where("n > 0")
    copies = copies.select("_s", "_b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    order = Window.partitionBy("_s").orderBy("copy", F.xxhash64(F.lit(seed), "copy", "_b"), "_b")
    placed = copies.withColumn("place", F.row_number().over(order) - 1)
    quotas = shard_quotas(copies.groupBy(F.col("_s").alias("source")).agg(F.count(F.lit(1)).alias("quota")), levels, seed)
    ends = quotas.where("quota > 0").select("source", "shard", "first", (F.col("first") + F.col("quota")).alias("last"))
    spread = placed.join(ends, F.col("_s").eqNullSafe(F.col("source")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
    at = spread.groupBy(F.col("_s").alias("_t"), F.col("_b").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("at"))  # 4 copies at most
    both = blocks.join(at, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")), "left")
    none = F.array().cast("array<int>")
    return both.select("_s", "_b", "times", "room", F.coalesce(F.transform("at", lambda x: x["shard"]), none).alias("at"))


def in_blocks(rows: DataFrame, source: str, per: DataFrame) -> DataFrame:
    """rows with their source's columns of per, the source itself as _src, and _block."""
    small = per.select(F.col("source").alias("_src"), "source_size", "target", "blocks")
    return rows.join(near(small), F.col(source).eqNullSafe(F.col("_src"))).withColumn("_block", block_of(F.col("blocks")))


def with_plan(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """rows that are in_blocks() with times, room and `at` of their blocks."""
    return rows.join(near(dealt), F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left").drop("_s", "_b")


def taken(rows: DataFrame, whole: bool = False) -> DataFrame:
    """rows that are with_plan() with taken and shards: the words of each row that the mix takes, over all its
    copies, and the shard of each copy.

    Only a block that is cut is ordered row by row. whole: the row at the cut is taken whole if at least half
    of it would be, and else not at all; otherwise just so many of its words."""
    within = Window.partitionBy("_src", "_block").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.least(F.greatest(F.col("room") - (F.sum("_size").over(within) - F.col("_size")), F.lit(0)), F.col("_size"))
    inside = rows.where(F.col("room").isNull()).withColumn("part", F.lit(0).cast("long"))
    cut = rows.where(F.col("room").isNotNull()).withColumn("part", part)
    if whole:
        cut = cut.withColumn("part", F.when(F.col("part") * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0)))
    copies = F.when(F.col("_size") > 0, F.col("times") + (F.col("part") > 0).cast("long")).otherwise(0)
    each = inside.unionByName(cut).withColumn("shards", F.slice("at", F.lit(1), copies.cast("int")))
    return each.withColumn("taken", F.col("times") * F.col("_size") + F.col("part"))


def draw(n_all: Column, n_own: Column, n_left: Column, u: Column) -> Column:
    """A hypergeometric draw: how many of n_own land among n_left of n_all, by inversion of a uniform u.

    Probabilities are followed from the mode both ways by their ratios, relative to the mode's."""
    low, high = F.greatest(F.lit(0), n_left - (n_all - n_own)), F.least(n_own, n_left)
    mode = F.least(F.greatest(F.floor((n_left + 1) * (n_own + 1) / (n_all + 2)).cast("long"), low), high)
    up = lambda k: (n_own - k) * (n_left - k) / ((k + 1.0) * (n_all - n_own - n_left + k + 1.0))  # noqa: E731  p(k+1) / p(k)
    down = lambda k: k * (n_all - n_own - n_left + k) / ((n_own - k + 1.0) * (n_left - k + 1.0))  # noqa: E731  p(k-1) / p(k)
    begin = lambda p, sum_: F.struct(p.cast("double").alias("p"), sum_.cast("double").alias("t"), F.lit(None).cast("long").alias("k"))
    above = F.when(mode < high, F.sequence(mode, high - 1)).otherwise(F.array().cast("array<bigint>"))
    below = F.when(mode > low, F.sequence(mode, low + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def walk(ratio, shift: int, until: Column | None):
        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * ratio(k)
            t = acc["t"] + p
            hit = acc["k"] if until is None else F.when(acc["k"].isNotNull(), acc["k"]).when(t >= until, k + shift)
            return F.struct(p.alias("p"), t.alias("t"), hit.cast("long").alias("k"))

        return step

    total = F.lit(1.0) + F.aggregate(above, begin(F.lit(1.0), F.lit(0.0)), walk(up, 1, None), lambda a: a["t"]) + F.aggregate(below, begin(F.lit(1.0), F.lit(0.0)), walk(down, -1, None), lambda a: a["t"])
    goal = u * total
    rise = F.aggregate(above, begin(F.lit(1.0), F.lit(1.0)), walk(up, 1, goal))
    fall = F.aggregate(below, begin(F.lit(1.0), rise["t"]), walk(down, -1, goal), lambda a: a["k"])
    return F.when(goal <= 1, mode).otherwise(F.coalesce(rise["k"], fall, mode))


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, source, quota, first) for 2 ** levels shards from quotas (source, quota): the splitting tree.

    A node is a row with the list of its sources' quotas; a left child gets half of the node's blocks, drawn
    source after source without replacement. first: where the shard's stretch of the source's blocks begins."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source"), F.col("quota")))).alias("q")).withColumn("node", F.lit(0))
    for level in range(levels):

        def split(acc: Column, x: Column) -> Column:
            own = x["quota"]
            # A hash of the place as the random number: reruns agree.
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["source"]), 11) + 0.5) / F.lit(float(1 << 53))  # noqa: B023
            got = F.when(acc["all"] == own, acc["want"]).otherwise(draw(acc["all"], own, acc["want"], u))
            return F.struct((acc["all"] - own).alias("all"), (acc["want"] - got).alias("want"), F.array_append(acc["got"], got).alias("got"))

        node = node.withColumn("total", F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x["quota"]))
        begin = F.struct(F.col("total").alias("all"), F.floor(F.col("total") / 2).cast("long").alias("want"), F.array().cast("array<bigint>").alias("got"))
        node = node.withColumn("left", F.aggregate("q", begin, split, lambda acc: acc["got"]))
        lefts = F.transform("q", lambda x, i: F.struct(x["source"].alias("source"), F.get("left", i).alias("quota")))
        rights = F.transform("q", lambda x, i: F.struct(x["source"].alias("source"), (x["quota"] - F.get("left", i)).alias("quota")))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), lefts.alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), rights.alias("q")))
        node = node.select(F.explode(sides).alias("x")).select("x.*")
        if level % 2:  # keeps the plan small; the table has a row per node
            node = common.materialise(node)
    flat = node.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.quota")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def mix(docs: DataFrame, levels: int = 4, seed: int = 11) -> DataFrame:
    """The mixed table: rows of docs, all columns, once for each time that the mix takes them, in shuffled shards.

    2 ** levels shards; rows of a shard stand together in random order. Rows are taken whole (see taken()). The
    shard of a row's copy is that of its block's copy. Rows alike in id, source and text are taken as often as the
    plan counts them, also where the cut lies between them. Further columns, of any name, stay as they are."""
    with common.scratch(docs.sparkSession):
        rows = sized(docs, seed).withColumn("_p", F.spark_partition_id())
        slim = common.materialise(rows.select("_doc.doc_id", "_doc.source", "_size", "_h"))
        per = common.materialise(targets(slim), outer=True)
        small = in_blocks(slim, "source", per)
        plan_ = common.materialise(place(block_plan(small), levels, seed), outer=True)
        got = taken(with_plan(small, plan_).where(F.col("room").isNotNull()), whole=True)
        each = got.groupBy(F.col("_h").alias("_g"), F.col("doc_id").alias("_d"), "shards").agg(F.count(F.lit(1)).alias("n"))
        # Rows alike are of one block, so there is one list of shards for them, or two where the block is cut.
        mine = common.materialise(each.groupBy("_g", "_d").agg(F.array_sort(F.collect_list(F.struct("shards", "n"))).alias("lists")), outer=True)
    # Rows of a block that isn't cut follow the block, so only the cut ones are looked up one by one.
    full = with_plan(in_blocks(rows.drop("_size"), "_doc.source", per), plan_)
    full = full.join(near(mine), (F.col("_h") == F.col("_g")) & F.col("_doc.doc_id").eqNullSafe(F.col("_d")) & F.col("room").isNotNull(), "left")
    uncut = F.when(F.col("_doc.text").rlike(common.WORD), F.slice("at", F.lit(1), F.col("times").cast("int")))
    shards = F.when(F.col("room").isNull(), uncut).when(F.size("lists") == 1, F.get("lists", 0)["shards"])
    dealt = full.select("_doc", "_h", F.posexplode(shards).alias("_copy", "_shard"))
    if not mine.where(F.size("lists") > 1).isEmpty():
        dealt = dealt.unionByName(divided(full.where(F.size("lists") > 1).select("_doc", "_h", "_p", "_g", "_d", "lists")))
    dealt = dealt.withColumn("_o", F.xxhash64(F.lit(seed), "_h", "_copy"))
    return dealt.repartitionByRange("_shard", "_o").sortWithinPartitions("_shard", "_o").select("_doc.*")


def divided(rows: DataFrame) -> DataFrame:
    """(_doc, _h, _copy, _shard) of rows alike that share out several lists of shards, each for so many of them.

    Rows are numbered within the partition (_p) that they were read in, and counts by partition put in front."""
    rows = common.materialise(rows)
    parts = rows.groupBy("_g", "_d", "_p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_g", "_d").orderBy("_p")) - F.col("n")
    parts = parts.select(F.col("_g").alias("_g2"), F.col("_d").alias("_d2"), F.col("_p").alias("_p2"), before.alias("_before"))
    same = (F.col("_g") == F.col("_g2")) & F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_p") == F.col("_p2"))
    own = F.row_number().over(Window.partitionBy("_g", "_d", "_p").orderBy(F.to_json("_doc")))
    placed = rows.withColumn("_own", own).join(parts, same).withColumn("_place", F.col("_before") + F.col("_own"))
    ends = F.transform("lists", lambda x, i: F.aggregate(F.slice("lists", F.lit(1), i + 1), F.lit(0).cast("long"), lambda acc, y: acc + y["n"]))
    which = F.size(F.filter(ends, lambda end: end < F.col("_place")))
    return placed.select("_doc", "_h", F.posexplode(F.get("lists", which)["shards"]).alias("_copy", "_shard"))


def plan(docs: DataFrame, levels: int = 4, seed: int = 11, whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken and shards (one entry per copy).

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own, last in
    order; rows alike in id, source and text may share a cut in any order, as their results are the same."""
    with common.scratch(docs.sparkSession):
        slim = common.materialise(sized(docs, seed).select("_doc.doc_id", "_doc.source", "_size", "_h"))
        small = in_blocks(slim, "source", common.materialise(targets(slim)))
        got = common.materialise(taken(with_plan(small, common.materialise(place(block_plan(small), levels, seed))), whole), outer=True)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken", "shards")
