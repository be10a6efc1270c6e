"""Trie of the conversations' common beginnings, by preorder intervals.

A node is a distinct sequence of the first turns of some conversations. Sequences are told apart by running sums of 128
bits of every turn's hash with its place; the sums are taken in two levels, so a conversation may have any length.
Distinct whole sequences get lexicographic ranks: one of up to ``WIDTH`` turns is ordered by its array of turns; for longer
ones every block of ``WIDTH`` turns is first named by the rank of its content among all blocks, and the names are the turns of
the next round. All sequences below a node are neighbours in that order, so (first rank, depth) is the preorder, and
a node's subtree is the interval from its place to the last node of its last rank. Leaves and savings of a
subtree are differences of prefix sums over that order.

Copies of a conversation are one sequence with a count before anything is ranked. Ids that end in one node are put
together in pieces of ``PIECE``; only the finished text of them, which a digest needs as one value, is whole (2 GB at most).

Defined results: turns go by their number (null first), then role and text; repeated rows are turns of their own; null
roles and texts are empty; rows without a conversation's id take no part; no conversations give no nodes; conversations
without turns end in the root. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, placed, running_totals, settled

WIDTH, PIECE, BUCKET = 64, 8192, 4096
LANES = ("s0", "s1", "s2", "s3")
ROOT = ":".join("0" * 5)


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, t0, t1, bytes, size) of (conv_id, turn, role, text) rows; t0 and t1 stand for role and text."""
    said = rows.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    told = said.select("*", F.xxhash64("role", "text").alias("t0"), F.xxhash64(F.lit("b"), "role", "text").alias("t1"), F.octet_length("text").cast("long").alias("bytes"))
    laid = placed(told, ["conv_id", "turn", "role", "text"], only=["conv_id", "t0", "t1", "bytes"])
    firsts = settled(laid.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("size"), F.count("*").alias("n")))
    return looked_up(laid, firsts, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "t0", "t1", "bytes", "size")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another, as (conv_id, d from 1, t0, t1, bytes, total) and (conv_id, total).

    Conversation c takes h = crc32(c as decimal text) % ``most`` turns of conversation c - c % ``every``, then its own after the first h.
    """
    own = settled(turns)
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % most
    convs = own.groupBy("conv_id").agg(F.max("size").alias("size")).select("conv_id", "size", h.alias("h"), (c - c % every).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    total = F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    convs = settled(convs.join(bases, "base", "left").withColumn("taken", taken).withColumn("total", total).select("conv_id", "base", "h", "taken", "total", F.col("size").alias("n")))
    later = looked_up(own.drop("size"), convs.select("conv_id", "h", "taken", "total", "n"), "conv_id").where("pos >= h")
    later = later.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "t0", "t1", "bytes", "total")
    heads = own.where(F.col("pos") < most - 1).select(F.col("conv_id").alias("base"), "pos", "t0", "t1", "bytes")
    heads = heads.join(convs, "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("d"), "t0", "t1", "bytes", "total")
    return heads.unionByName(later), convs.select("conv_id", "total")


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.concat_ws(":", depth, *lanes)


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds ``node``, which stands for the turns up to this one, and ``up``, for those before it."""
    halves = [half for t in ("t0", "t1") for half in (F.shiftrightunsigned(F.xxhash64(t, "d"), 32), F.xxhash64(t, "d").bitwiseAND(0xFFFFFFFF))]
    told = turns.select("*", *[half.alias(f"l{k}") for k, half in enumerate(halves)], F.floor(F.col("d") / BUCKET).alias("part"))
    summed = running_totals(told, ["conv_id"], ["part"], ["d"], {s: f"l{k}" for k, s in enumerate(LANES)})
    up = _key(F.col("d") - 1, [F.col(s) - F.col(f"l{k}") for k, s in enumerate(LANES)])
    return summed.select(*turns.columns, _key(F.col("d"), [F.col(s) for s in LANES]).alias("node"), up.alias("up"))


def _blocks(items: DataFrame) -> DataFrame:
    """(conv_id, i, key): the items of each conversation's i-th block in order."""
    met = items.groupBy("conv_id", F.floor(F.col("i") / WIDTH).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("key"))
    return met.withColumn("key", F.transform("key", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))


def lexicographic(items: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, rank) for distinct sequences, given as (conv_id, i, a, b) items; ``convs`` names them all, empty ones too."""
    longest = items.agg(F.max("i")).first()[0] or 0
    while longest >= WIDTH:
        blocks = settled(_blocks(items))
        names = placed(blocks.groupBy("key").agg(F.count("*").alias("n")), ["key"])
        items = looked_up(blocks, names, "key").select("conv_id", "i", F.col("at").alias("a"), F.lit(0).cast("long").alias("b"))
        longest //= WIDTH
    keys = convs.join(_blocks(items).select("conv_id", "key"), "conv_id", "left")
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return placed(keys.select("conv_id", F.coalesce("key", empty).alias("key")), ["key"], "rank", only=["conv_id"])


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id) rows."""
    laid = placed(ends, ["node", "conv_id"])
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = laid.groupBy("node", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]), ",")
    return pieces.groupBy("node").agg(F.sha2(whole, 256).alias("ends_sha256"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as (conv_id, d, t0, t1, bytes, total) turns and (conv_id, total) rows."""
    told = settled(prefixes(turns))
    ends = told.where(F.col("d") == F.col("total")).select("conv_id", "node").unionByName(convs.where("total = 0").select("conv_id", F.lit(ROOT).alias("node")))
    ends = settled(ends)
    some = settled(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    kept = some.join(convs, "conv_id").select("conv_id", "copies", F.col("total").alias("n"))
    walked = settled(looked_up(told.drop("total"), kept, "conv_id").where(F.col("copies").isNotNull()))
    ranks = lexicographic(walked.select("conv_id", (F.col("d") - 1).alias("i"), F.col("t0").alias("a"), F.col("t1").alias("b")), some.select("conv_id"))
    ranks = settled(ranks.join(kept, "conv_id"))

    members = (F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    paths = looked_up(walked, ranks.select("conv_id", "rank", "n"), "conv_id")
    nodes = paths.groupBy("node").agg(*members, F.first("d").alias("depth"), F.first("up").alias("up"), F.first("bytes").alias("bytes"))
    root = ranks.agg(*members).where("n_convs > 0").select(F.lit(ROOT).alias("node"), "*", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("bytes"))
    nodes = settled(nodes.unionByName(root))

    kids = nodes.where("depth > 0").groupBy("up").agg(F.count("*").alias("n_children"))
    nodes = settled(nodes.join(kids.withColumnRenamed("up", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    nodes = looked_up(nodes, settled(parents), "up")
    weighed = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes"))
    laid = placed(weighed, ["lo", "depth"]).withColumn("part", F.floor(F.col("at") / BUCKET))
    summed = settled(running_totals(laid, [], ["part"], ["at"], {"leaves": "leaf", "saved": "weight"}))
    upto = summed.groupBy(F.col("lo").alias("hi")).agg(F.max("leaves").alias("leaves_end"), F.max("saved").alias("saved_end"))
    upto = settled(upto.join(summed.groupBy("hi").agg(F.count("*").alias("n")), "hi"))
    spans = looked_up(summed, upto, "hi")
    out = spans.join(_ends(ends), "node", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved") + F.col("weight")).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
        F.col("at").alias("place"),
    )
