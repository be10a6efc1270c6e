"""Applying chosen differences of a trial to the library.

A trial's plan has (image, step, finding, title, target, other): ``existing`` with an item, ``same`` with an earlier step of the picture,
``new``, or ``possible`` with the item that it may be a copy of. A chosen step needs the step whose item it joins, which
needs its own; that closure, and the step that each step's item comes from, are found in one pass over the plan by picture. Items are
looked up as they are now, at the ends of their merges.

Ids of new items and sightings come from the findings, so applying the same choice twice gives the same tables.
Results: ``applied``, or ``item gone`` where the item no longer exists, or ``no longer applies`` for a choice that the plan does not have, or
that joins a step without an item. Columns other than these are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise
from ..sources.folders import settled
from .actions import survivors

SIGHTING = "struct<id:string,title:string,norm:string>"


def _closed(rows: pa.Table) -> pa.Table:
    """Needed steps of whole pictures, in the order of (image, step), with the ``end`` of each: the step that its item comes from, null if there is none."""
    rows = rows.combine_chunks()
    n, image = rows.num_rows, rows["image"]
    change = np.append(True, pc.not_equal(image[1:], image[:-1]).to_numpy(zero_copy_only=False)) if n > 1 else np.ones(n, bool)
    picture, step = np.cumsum(change).astype(np.int64) << 33, rows["step"].cast("int64").to_numpy()
    key, to = picture + step, rows["_to"].cast("int64")
    joins, want = to.is_valid().to_numpy(zero_copy_only=False), picture + to.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(key, want), n - 1)
    up = np.where(joins, np.where(key[at] == want, at, n), np.arange(n))  # n: a step that the plan does not have
    needed, edge = np.zeros(n + 1, bool), np.flatnonzero(rows["_chosen"].fill_null(False).to_numpy(zero_copy_only=False))
    up, needed[n] = np.append(up, n), True
    while len(edge):
        needed[edge] = True
        edge = np.unique(up[edge])
        edge = edge[~needed[edge]]
    end = up
    for _ in range(n.bit_length() + 1):  # pointers double in reach each round; a circle has no end
        end = end[end]
    ended = np.append(~joins, False)[end]
    kept = np.flatnonzero(needed[:n])
    ends = pa.array(end[kept], mask=~ended[kept])
    out = rows.take(pa.array(kept))
    for name in ("finding", "target", "other"):
        out = out.append_column(f"_{name}", rows[name].take(ends))
    return out.drop_columns(["_to", "_chosen"])


def needed_steps(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """The plan's chosen steps and all that they join, each with ``_finding``, ``_target`` and ``_other`` of the step that its item comes from.

    Rows arrive sorted by picture; a picture's rows are held together.
    """
    marked = plan.where("image is not null and step is not null").join(chosen.select("finding").distinct().withColumn("_chosen", F.lit(True)), "finding", "left")
    kept = marked.select("image", "step", "finding", "title", "target", "other", F.when(F.col("target") == "same", F.col("other").cast("int")).alias("_to"), "_chosen")
    wide = kept.drop("_to", "_chosen").select("*", *[F.col(c).alias(f"_{c}") for c in ("finding", "target", "other")])
    told = T.StructType([T.StructField(f.name, f.dataType) for f in wide.schema])  # any of them may be null

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            image = batch["image"]
            cuts = np.flatnonzero(pc.not_equal(image[1:], image[:-1]).to_numpy(zero_copy_only=False)) + 1
            cut = int(cuts[-1]) if len(cuts) else 0
            if held and (cut or image[0] != held[-1]["image"][-1]):
                yield from _closed(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
            elif cut:
                yield from _closed(pa.Table.from_batches([batch.slice(0, cut)])).to_batches()
            if batch.num_rows > cut:
                held.append(batch.slice(cut))
        if held:
            yield from _closed(pa.Table.from_batches(held)).to_batches()

    return kept.repartition("image").sortWithinPartitions("image", "step").mapInArrow(closed, told)


def resolved_steps(steps: DataFrame, items: DataFrame) -> DataFrame:
    """Adds ``item`` (null if there is none any more), ``joined`` and ``beside``, the live item that a new one may be a copy of."""
    live = survivors(items).select(F.col("item").cast("string").alias("_other"), F.col("live").cast("string").alias("live"))
    told = steps.join(live, "_other", "left")
    new = F.concat(F.lit("new:"), F.col("_finding").cast("string"))
    item = F.when(F.col("_target") == "existing", F.col("live")).when(F.col("_target").isin("new", "possible"), new)
    told = told.withColumn("item", item).withColumn("beside", F.when(F.col("target") == "possible", F.col("live")))
    return told.withColumn("joined", F.col("target").isin("existing", "same")).drop("_finding", "_target", "_other", "live")


def apply_selected(plan: DataFrame, chosen: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps to make, (image, step, finding, title, item, joined, beside), and (finding, outcome) of every choice."""
    made = settled(resolved_steps(needed_steps(plan, chosen), items))
    told = chosen.select("finding").distinct().join(made.select("finding", "target", "item"), "finding", "left")
    outcome = F.when(F.col("item").isNotNull(), "applied").when(F.col("target") == "existing", "item gone").otherwise("no longer applies")
    return made.where("item is not null"), told.select("finding", outcome.alias("outcome"))


def replaced_sightings(plan: DataFrame, made: DataFrame, sightings: DataFrame, items: DataFrame) -> DataFrame:
    """(image, item, finding, sighting): the old sighting of an item in the same picture that a joining step takes the place of.

    In the order of steps each takes one that is left: with its title, else with its normalised title, else the first that no other proposal
    of the picture for that item accounts for. The few sightings of one item in one picture meet in one row.
    """
    live = survivors(items).select(F.col("item").cast("string").alias("other"), F.col("live").cast("string").alias("item"))
    said = plan.where("target = 'existing'").join(live, "other").where("item is not null").groupBy("image", "item").agg(F.collect_list(F.struct("finding", normalise(F.col("title")).alias("norm"))).alias("said"))
    olds = sightings.groupBy("image", F.col("item").cast("string").alias("item")).agg(F.array_sort(F.collect_list(F.struct("created", "sighting", F.trim("title").alias("title"), normalise(F.col("title")).alias("norm")))).alias("olds"))
    steps = made.where("joined").groupBy("image", "item").agg(F.array_sort(F.collect_list(F.struct("step", "finding", F.trim("title").alias("title"), normalise(F.col("title")).alias("norm")))).alias("steps"))
    rows = steps.join(olds, ["image", "item"]).join(said, ["image", "item"], "left")

    def pick(t: Column, used: Column) -> Column:
        left = F.filter("olds", lambda s: ~F.array_contains(used, s["sighting"]))
        others = F.filter(F.coalesce("said", F.array().cast("array<struct<finding:string,norm:string>>")), lambda x: x["finding"].cast("string") != t["finding"].cast("string"))
        rank = lambda s: F.when(s["title"] == t["title"], 0).when(s["norm"] == t["norm"], 1).when(~F.exists(others, lambda x: x["norm"] == s["norm"]), 2)
        ranked = F.transform(left, lambda s: F.struct(rank(s).alias("rank"), s["created"].alias("created"), s["sighting"].alias("sighting")))
        return F.array_min(F.filter(ranked, lambda s: s["rank"].isNotNull()))["sighting"]

    kind = "array<struct<finding:string,sighting:string>>"

    def step(done: Column, t: Column) -> Column:
        def taken(s: Column) -> Column:
            more = F.struct(F.concat(done["used"], F.array(s)).alias("used"), F.concat(done["pairs"], F.array(F.struct(t["finding"].cast("string").alias("finding"), s.alias("sighting")))).cast(kind).alias("pairs"))
            return F.when(s.isNull(), done).otherwise(more)

        return F.transform(F.array(pick(t, done["used"])), taken)[0]

    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(kind).alias("pairs"))
    return rows.select("image", "item", F.inline(F.aggregate("steps", start, step)["pairs"]))
