"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are what fixed formats prove (e-mail, IPv4, card with its check digit, phone with its plus). The words on
either side of seeds and of look-alikes are lexical patterns. Patterns and identifiers form a bipartite graph: a
pattern's score is the belief in the identifiers it stands beside, an identifier's belief is 1 for seeds and
otherwise the noisy-or of the scores of the patterns that were accepted. Patterns above a confidence with enough
believed identifiers are accepted; the look-alikes beside them join the identifiers and so lend belief to further
patterns, until a round accepts no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base formats: they match the same and run in linear time without recursion. A run of
#: letters of which one start fails fails from all others, so only the first start of a run, or the place where
#: the last match ended, is tried.
FIND = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "veiled": r"[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9.-]++",
}
#: Texts that hold no match are told by these, which are cheaper than a search with places.
HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){7}"),
    "phone": lambda t: t.contains("+"),
    "veiled": lambda t: t.contains("(at)") | t.contains("[at]"),
}
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
SPAN = "array<struct<k:int,s:bigint,e:bigint,seed:boolean,v:string,l:string,r:string>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def judge(kind: str, m: Column) -> tuple[Column, Column, Column]:
    """(kind number, is a seed, is a look-alike) of one match."""
    d = digits(m)
    n = F.length(d)
    if kind == "email":
        return F.lit(0), F.lit(True), F.lit(False)
    if kind == "veiled":
        return F.lit(0), F.lit(False), F.lit(True)
    if kind == "ip":
        return F.lit(1), m.rlike(OCTETS), ~m.rlike(OCTETS)
    if kind == "phone":
        return F.lit(3), n.between(8, 15), F.lit(False)
    seed = n.between(16, 19) & F.when(n.between(16, 19), luhn(d)).otherwise(False)
    return F.when(n >= 13, 2).otherwise(3), seed, n.between(8, 19)


def beside(piece: Column, left: bool) -> Column:
    """The word of a piece of text that touches a match, in lower case with digits as 0; empty where there is none."""
    near = F.right(piece, F.lit(60)) if left else F.left(piece, F.lit(60))
    word = F.regexp_extract(near, r"(\S++)\s*+$" if left else r"^\s*+(\S++)", 1)
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def in_blocks(items: Column, step: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """A struct of `out`, an array with the array of each block of items, and `at`, a running number from 0.

    step(acc, item) appends to acc's `out`, an array of kind, and moves its `at`. An array that grows by one is copied
    each time, so one for all items of a long text would take the square of their number."""
    empty = F.array().cast(f"array<{kind}>")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda j: F.slice(items, j * block + 1, F.lit(block)))
    blocks = F.when(F.size(items) > block, cut).otherwise(F.array(items))

    def join(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(empty.alias("out"), acc["at"].alias("at")), step)
        return F.struct(F.array_append(acc["out"], done["out"]).alias("out"), done["at"].alias("at"))

    begin = F.struct(F.array().cast(f"array<array<{kind}>>").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(blocks, begin, join)


def places(kind: str, m: Column, p: Column) -> Column:
    """Spans of the matches m, which stand between the pieces p, that are seeds or look-alikes."""

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(p, i))
        return F.struct(F.array_append(acc["out"], start).alias("out"), (start + F.length(F.get(m, i))).alias("at"))

    starts = F.flatten(in_blocks(F.sequence(F.lit(0), F.size(m) - 1), step, "bigint")["out"])

    def span(start: Column, i: Column) -> Column:
        own = F.get(m, i)
        number, seed, alike = judge(kind, own)
        value = F.lower(own) if kind in ("email", "veiled", "ip") else digits(own)
        return F.struct(
            number.cast("int").alias("k"), start.alias("s"), (start + F.length(own)).cast("long").alias("e"), seed.alias("seed"),
            F.when(seed | alike, value).alias("v"), beside(F.get(p, i), True).alias("l"), beside(F.get(p, i + 1), False).alias("r"),
        )

    return F.filter(F.transform(starts, span), lambda x: x["v"].isNotNull())


def spans(docs: DataFrame) -> DataFrame:
    """`doc`, a struct of docs' columns, with `base`, the spans of the fixed formats in its text by kind and start, and
    `alike`, look-alikes that touch none of them.

    Every pass over a text stands in its own projection, so no search runs twice."""
    nothing = F.array().cast(SPAN)
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    out = docs.select(common.packed(docs).alias("doc")).withColumns({f"_h_{k}": hint(text) for k, hint in HINT.items()})
    out = out.withColumns({f"_m_{k}": F.when(F.col(f"_h_{k}"), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in FIND.items()})
    some = {k: F.size(F.coalesce(F.col(f"_m_{k}"), F.array().cast("array<string>"))) > 0 for k in FIND}
    out = out.withColumns({f"_p_{k}": F.when(some[k], F.split(text, p, -1)) for k, p in FIND.items()})
    out = out.withColumns({f"_s_{k}": F.coalesce(F.when(some[k], places(k, F.col(f"_m_{k}"), F.col(f"_p_{k}"))), nothing) for k in FIND})
    out = out.withColumn("base", F.filter(F.concat(*[F.col(f"_s_{k}") for k in KINDS]), lambda x: x["seed"]))
    touch = lambda x: F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
    out = out.withColumn("alike", F.filter(F.concat(*[F.col(f"_s_{k}") for k in FIND]), lambda x: ~x["seed"] & ~touch(x)))
    return out.drop(*[f"_{a}_{k}" for a in "hmps" for k in FIND])


def accepted(edges: DataFrame, confidence: float, least: int, rounds: int) -> DataFrame:
    """(k, side, word, score): patterns of the graph edges (k, side, word, v, seed) that are accepted in the end.

    score = sum of beliefs / (identifiers + 2), so rare patterns score low; `least` identifiers must be believed. Beliefs
    and scores only grow, so a round that accepts no more and in which scores settle ends the search; `rounds` bounds it.
    Each half-round is one sum by pattern or by identifier with partial sums before its shuffle; its result is written,
    so that a pattern or identifier with a large share of the edges is split when it is joined again."""
    at = ["k", "side", "word"]
    sure, last = None, (-1, 0.0)
    believed = edges.withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for _ in range(rounds):
        scores = believed.groupBy(*at).agg((F.sum("belief") / (F.count(F.lit(1)) + 2)).alias("score"), F.sum((F.col("belief") > 0).cast("long")).alias("believed"))
        sure = common.materialise(scores.where((F.col("score") >= confidence) & (F.col("believed") >= least)).select(*at, "score"))
        now = tuple(sure.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first())
        if now[0] == 0 or now[0] == last[0] and now[1] - last[1] <= 1e-3:
            break
        last = now
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        beliefs = common.materialise(edges.where(~F.col("seed")).join(sure, at).groupBy("k", "v").agg((1 - F.exp(doubt)).alias("got")))
        believed = edges.join(beliefs, ["k", "v"], "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("got", F.lit(0.0))))
    return sure


def find(docs: DataFrame, rounds: int = 20, confidence: float = 0.6, least: int = 3, keep_text: bool = True) -> DataFrame:
    """Rows of docs, each as a struct `doc`, with `base` and `added`, arrays of spans (k: number in KINDS, s, e: code
    points, end exclusive).

    A null text counts as empty; repeated rows and null ids are told apart by their place; further columns, of
    any name, stay in the struct as they are. keep_text: whether the text stays in it, which redact() needs."""
    with common.scratch(docs.sparkSession):
        found = spans(docs)
        found = found if keep_text else found.withColumn("doc", F.col("doc").dropFields("text"))
        rows = common.materialise(found.withColumn("_row", F.monotonically_increasing_id()), outer=True)
        each = rows.select("_row", F.explode(F.concat("base", "alike")).alias("x")).select("_row", "x.*")
        sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("word")), F.struct(F.lit("r").alias("side"), F.col("r").alias("word"))))
        beside_each = each.select("_row", "k", "s", "e", "seed", "v", sides.alias("y")).select("_row", "k", "s", "e", "seed", "v", "y.*").where("word <> ''")
        edges = common.materialise(beside_each.groupBy("k", "side", "word", "v").agg(F.max("seed").alias("seed")))
        sure = accepted(edges, confidence, least, rounds).select("k", "side", "word")
        hits = beside_each.where(~F.col("seed")).join(sure, ["k", "side", "word"]).select("_row", F.struct("k", "s", "e").alias("x"))
        added = common.materialise(hits.groupBy("_row").agg(F.array_sort(F.collect_set("x")).alias("added")), outer=True)  # one text's own spans
    base = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))).alias("base")
    none = F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")
    return rows.join(added, "_row", "left").select("doc", base, F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by kind and start."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, and all spans of find()'s rows."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redact(found: DataFrame) -> DataFrame:
    """The rows given to find(), with [KIND] in place of each span of text (overlapping spans share the first one's mark)."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    cut = lambda a, b: F.substring(F.col("doc.text"), (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.array(cut(acc["at"], x["s"]), F.get(marks, x["k"]))
        return F.struct(F.when(x["s"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    done = in_blocks(F.col("_every"), step, "string")
    whole = F.concat(F.array_join(F.transform(done["out"], lambda x: F.array_join(x, "")), ""), cut(done["at"], F.length("doc.text").cast("long")))
    text = F.when((F.size("base") + F.size("added") > 0) & F.col("doc.text").isNotNull(), whole).otherwise(F.col("doc.text"))
    return found.withColumn("_every", every).select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
