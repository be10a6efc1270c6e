"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

A window is ``window`` consecutive words of an item (the whole item if it has fewer words). Documents and windows are
sets of shingles of ``SHINGLE`` words (fewer for items that have fewer). Exact containment needs every shingle of the
window, so one necessary prefix token is enough: its rarest shingle over all documents. Documents are split once and
their shingles meet the items' vocabulary; what is there is kept. Then a document's prefix tokens fix where windows must
lie; a window has to fit inside the document (length and positional bounds), and the item-sized run of words there is
compared with the window, word by word as text.

Documents are told apart by id and a key of the text, which every scan of the table gives alike; rows equal in both have
equal results. No row of a join or broadcast carries an item or more than one window, and lists of a document hold
places only.

Defined results: null or wordless texts have no words and are clean; wordless items, and items with a null id,
take no part; rows of the same item id count once in ``items``; each document row gives one result row, repeated
ids included; an empty table gives no rows or no hits. Other columns of the documents are not carried.
DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, met_with, sent_if_small, settled, text_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Stands after a document's shingles and carries the number of its words; never a shingle's hash in the vocabulary.
CLOSING = -(1 << 63) + 1
#: Words of benchmark items that one broadcast comes from at most; more items are taken in several passes.
BLOCK_WORDS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(hashed: Column, size: int) -> Column:
    """The hashes of all runs of ``size`` hashed words."""
    starts = F.sequence(F.lit(1), F.size(hashed) - (size - 1))
    run = lambda p: F.xxhash64(F.lit(size), *[F.element_at(hashed, p + k) for k in range(size)])
    return F.when(F.size(hashed) >= size, F.transform(starts, run)).otherwise(F.array().cast("array<bigint>"))


def _placed(tokens: Column, size: int) -> Column:
    return F.transform(tokens, lambda t, p: F.struct(p.alias("p"), F.lit(size).alias("size"), t.alias("token")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, size, tokens, text): every window of every item, with its shingles in order."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("iw")).where(F.col("item").isNotNull() & (F.size("iw") > 0))
    size = F.least(F.size("iw"), F.lit(window))
    placed = split.select("item", "iw", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("iw") - size + 1)).alias("s"))
    cut = placed.select("item", "size", F.slice("iw", F.col("s"), F.col("size")).alias("w"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    least = min(SHINGLE, window)
    tokens = shingles(hashed, least)
    for k in range(1, least):
        tokens = F.when(F.col("size") == k, shingles(hashed, k)).otherwise(tokens)
    return cut.select("item", "size", tokens.alias("tokens"), F.array_join("w", " ").alias("text")).distinct()


def item_blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in blocks of about ``block_words`` words, so that what comes of each may be broadcast."""
    total = items.agg(F.sum(F.size(words(F.col("text"))))).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items] if n == 1 else [items.where(place == k) for k in range(n)]


def _covered(places: Column) -> Column:
    """How many words lie inside any of the (b, size) places, given in ascending order."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = x["b"] + x["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(s["upto"], x["b"]))
        return F.struct(F.greatest(s["upto"], end).alias("upto"), (s["n"] + fresh).alias("n"))

    return F.aggregate(places, zero, step)["n"]


def find_contamination(documents: DataFrame, items: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document row: doc_id, key, n_words, n_hit, items (ids as text, ascending); ``key`` is the text's ``text_key``."""
    texts = documents.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    hashed = texts.select("doc_id", "key", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("dw"))
    closing = F.array(F.struct(F.size("dw").alias("p"), F.lit(0).alias("size"), F.lit(CLOSING).alias("token")))
    docs, found = None, None
    for block in item_blocks(items, block_words):
        windows = settled(item_windows(block, window))
        sizes = sorted(r["n"] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("n")).distinct().collect())  # at most SHINGLE numbers
        runs = [_placed(shingles(F.col("dw"), k), k) for k in sizes]
        there = hashed.select("doc_id", "key", F.explode(F.concat(*runs, closing)).alias("x")).select("doc_id", "key", "x.*")
        vocabulary = windows.select(F.explode("tokens").alias("token")).distinct()
        if docs is None:
            vocabulary = vocabulary.unionByName(documents.sparkSession.range(1).select(F.lit(CLOSING).alias("token")))
        hits = settled(there.join(F.broadcast(vocabulary), "token"))
        if docs is None:
            docs = hits.where(F.col("size") == 0).select("doc_id", "key", F.col("p").cast("long").alias("n_words"))
        hits = hits.where(F.col("size") > 0).distinct()  # of equal rows once
        seen = hits.groupBy("token").agg(F.count("*").alias("df"))
        placed = windows.select("item", "size", "text", F.size("tokens").alias("k"), F.posexplode("tokens").alias("o", "token")).join(seen, "token")
        rarest = placed.groupBy("size", "text", "k").agg(F.count_distinct("o").alias("met"), F.min(F.struct("df", "token", "o")).alias("x"))
        prefix = rarest.where(F.col("met") == F.col("k")).select(F.col("x.token").alias("token"), F.col("x.o").alias("o"), F.col("size").alias("n"), F.xxhash64("text").alias("w"))
        near = hits.join(F.broadcast(prefix), "token").select("doc_id", "key", (F.col("p") - F.col("o")).alias("b"), "n", "w").where("b >= 0")
        near = near.groupBy("doc_id", "key").agg(F.collect_set(F.struct("b", F.col("n").alias("size"), "w")).alias("near"))
        near = settled(near.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "near"))
        split = met_with(texts, near, {"key": "_key", "doc_id": "_id"})
        split = split.select("doc_id", "key", "near", words(F.col("text")).alias("dw"))
        fits = F.filter("near", lambda x: x["b"] + x["size"] <= F.size("dw"))
        cut = F.transform(fits, lambda x: F.struct(x["b"].alias("b"), x["size"].alias("size"), F.array_join(F.slice("dw", x["b"] + 1, x["size"]), " ").alias("text"), x["w"].alias("w")))
        same = F.filter(cut, lambda x: F.xxhash64(x["text"]) == x["w"])
        held = split.select("doc_id", "key", F.explode(same).alias("x")).select("doc_id", "key", "x.b", "x.size", "x.text").distinct()
        one = held.join(windows.select("item", "size", "text"), ["size", "text"]).select("doc_id", "key", "b", "size", "item")
        found = settled(one) if found is None else found.unionByName(settled(one))
    places = F.array_sort(F.collect_set(F.struct("b", "size")))
    counted = found.groupBy("doc_id", "key").agg(places.alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
    counted = counted.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), _covered(F.col("places")).alias("hit"), "items")
    counted = settled(counted)
    out = docs.join(sent_if_small(counted), F.col("key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "key", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def contaminated(n_hit: Column, n_words: Column, part: int = 20) -> Column:
    """A hit, and at least one word in ``part`` hit."""
    return (n_hit > 0) & (part * n_hit >= n_words)
