"""Diffs of runs, sync plans and run compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(stored: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, fields): new, changed, unchanged or notFound, and the names of fields that differ."""
    a = stored.select(F.col(key), F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = proposed.select(F.col(key), F.lit(True).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), f) for f in fields]))
    names = F.when(F.col("_a") & F.col("_b"), F.array_join(changed, ",")).otherwise("")
    state = F.when(F.col("_b").isNull(), "notFound").when(F.col("_a").isNull(), "new").when(names == "", "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"), names.alias("fields"))


def paired(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, state): the n-th row of a key on either side, and whether the other side has an n-th too."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    a, b = first.select(*keys, number.alias("_n"), F.lit(True).alias("_a")), second.select(*keys, number.alias("_n"), F.lit(True).alias("_b"))
    state = F.when(F.col("_b").isNull(), "onlyInFirst").when(F.col("_a").isNull(), "onlyInSecond").otherwise("both")
    return a.join(b, [*keys, "_n"], "full_outer").select(*keys, state.alias("state"))


def sync_plan(items: DataFrame, links: DataFrame) -> DataFrame:
    """(item, action) of (item, ready, gone, hash) items and their (item, linked, state) links."""
    linked, stale = F.col("state").isNotNull(), (F.col("state") == "failed") | ~F.col("linked").eqNullSafe(F.col("hash"))
    action = (
        F.when(~linked & F.col("ready") & ~F.col("gone"), "create").when(~linked | (F.col("state") == "removed"), "skip")
        .when(F.col("gone"), "remove").when(~F.col("ready"), "skip").when(stale, "update").otherwise("skip")
    )
    return items.join(links, "item", "left").select("item", action.alias("action"))


def compacted(runs: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """(run, changes): (run, t, changes) rows in time order, without those that changed nothing and are followed by another such.

    A run's follower is in its own stretch of ``width`` of time, or the first of the next stretch that has any; only
    those firsts, one for each stretch, are ordered together.
    """
    cut = runs.withColumn("_bucket", F.floor(F.col("t") / width))
    first = cut.groupBy("_bucket").agg(F.min_by("changes", F.struct("t", "run")).alias("_first"))
    first = first.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_later"))
    after = F.coalesce(F.lead("changes").over(Window.partitionBy("_bucket").orderBy("t", "run")), "_later")
    told = cut.join(F.broadcast(first), "_bucket").withColumn("_next", after)
    return told.where((F.col("changes") > 0) | F.col("_next").isNull() | (F.col("_next") > 0)).select("run", "changes")
