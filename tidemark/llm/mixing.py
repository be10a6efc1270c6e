"""Mixing sources to target weights by systematic sampling.

Each document's expected copies (its source's target over the source's size) are summed up along the source, one
random offset is added, and a document is emitted once for each integer boundary its own share crosses. Shares are
fixed-point numbers, so the sums are exact and do not depend on how rows are spread over tasks. Documents of a
source are taken in order of size, then of a hash of the id; so sizes are sampled evenly and the words taken come
within about one large document of the target.

Defined results: a null text has size 0; null is a source of its own, the last one; a source without words has
target 0 and takes nothing; repeated rows are sampled one by one; an empty table gives no rows.
DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_total, settled, text_key, word_count

#: Binary digits behind the point of expected copies and offsets: sums of 2**38 documents fit a long.
POINT = 24
WEIGHTS = (5, 2, 1)
#: Rows of one size that are ordered in one task, at least; grows so that there are about a million such parts.
PART_ROWS = 512


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, get the weights in turn. Together they share ``total`` times all sizes by
    weight; none gets over ``most`` times its size, and the excess goes to the others by weight. That settles at a
    level ``target / weight`` common to all sources below their limit: sources are sorted by the level at which
    they reach it, and the first one that does not reach it shows the common level. One row for each source.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("reach", "place")
    weight = F.lit(None).cast("long")
    for k, w in enumerate(weights):
        weight = F.when((F.col("place") - 1) % len(weights) == k, F.lit(w).cast("long")).otherwise(weight)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name))
    per = per.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("reach", F.col("limit") / F.col("weight"))
    everyone = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    since = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (total * F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(since)
    per = per.withColumn("level", level).withColumn("common", F.when(F.col("level") <= F.col("reach"), F.col("level")))
    per = per.withColumn("common", F.first("common", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def _digits(text: Column, n: int) -> Column:
    """The first n hex digits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def copies_to_take(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows that have doc_id, source and size."""
    n = docs.count()
    rows = max(PART_ROWS, n // 1_000_000)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") * (1 << POINT) / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_mx_share", share).withColumnRenamed("source", "_mx_source")
    crowded = docs.groupBy("source", "size").count().where(F.col("count") > rows)
    crowded = crowded.select(F.col("source").alias("_mx_s"), F.col("size").alias("_mx_z"), F.ceil(F.col("count") / rows).alias("_mx_parts"))
    drawn = docs.join(plan, docs["source"].eqNullSafe(plan["_mx_source"]), "left").drop("_mx_source")
    drawn = drawn.join(crowded, drawn["source"].eqNullSafe(crowded["_mx_s"]) & (drawn["size"] == crowded["_mx_z"]), "left").drop("_mx_s", "_mx_z")
    drawn = drawn.withColumn("_mx_hash", _digits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8))
    drawn = drawn.withColumn("_mx_part", F.shiftright(F.col("_mx_hash") * F.coalesce(F.col("_mx_parts"), F.lit(1)), 32))
    summed = running_total(drawn, ["source"], ["size", "_mx_part"], ["_mx_hash", "doc_id"], "_mx_share", "_mx_to")
    offset = _digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))), POINT // 4)
    upto = lambda x: F.shiftright(x + offset, POINT)
    copies = upto(F.col("_mx_to")) - upto(F.col("_mx_to") - F.col("_mx_share"))
    return summed.withColumn("copies", copies).drop("_mx_share", "_mx_parts", "_mx_hash", "_mx_part", "_mx_to")


def mix(documents: DataFrame, seed: int = 0, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document."""
    narrow = settled(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return copies_to_take(narrow, source_targets(narrow, **shares), seed)


def mixed_documents(documents: DataFrame, seed: int = 0, **shares) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns stay as they are.

    The mix is drawn on narrow rows. Documents meet its result by id, source and a key of the text, so whole texts are
    shuffled once; rows alike in all three share their copies evenly.
    """
    source, key = documents["source"], text_key(documents["text"])
    narrow = settled(documents.select("doc_id", "source", word_count(documents["text"]).alias("size"), key.alias("key")))
    drawn = copies_to_take(narrow, source_targets(narrow, **shares), seed)
    taken = drawn.groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where(F.col("copies") > 0)
    taken = taken.select(F.col("doc_id").alias("_mx_id"), F.col("source").alias("_mx_source"), F.col("key").alias("_mx_key"), F.col("copies").alias("_mx_copies"), F.col("rows").alias("_mx_rows"))
    whole = documents.select(F.struct(*documents.columns).alias("_mx_row"), F.col("doc_id").alias("_mx_i"), source.alias("_mx_s"), key.alias("_mx_k"))
    met = whole.join(taken, F.col("_mx_id").eqNullSafe(F.col("_mx_i")) & F.col("_mx_source").eqNullSafe(F.col("_mx_s")) & F.col("_mx_key").eqNullSafe(F.col("_mx_k")))
    alike = Window.partitionBy("_mx_id", "_mx_source", "_mx_key").orderBy(F.lit(1))
    once = met.where("_mx_rows = 1").withColumn("_mx_n", F.col("_mx_copies"))
    more = met.where("_mx_rows > 1").withColumn("_mx_at", F.row_number().over(alike))
    more = more.withColumn("_mx_n", F.floor(F.col("_mx_copies") / F.col("_mx_rows")) + (F.col("_mx_at") <= F.col("_mx_copies") % F.col("_mx_rows")).cast("int")).drop("_mx_at")
    each = lambda rows: rows.where("_mx_n > 0").withColumn("_mx_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mx_n").cast("int")))).select("_mx_row.*")
    return each(once).unionByName(each(more))
