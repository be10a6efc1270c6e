"""What users do to items: a log of operations, and the states that follow from it.

A log has rows (op, at, kind, by_user, item, other, field, value, undoes). Kinds are edit, unlock, approve, unapprove,
dismiss, restore, merge (``other`` is the item kept), split (``other`` is the new item) and undo. ``op`` grows with time.
Nothing is rewritten: states are aggregates over what has not been undone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = ("dismiss", "restore", "merge")


def effective(log: DataFrame) -> DataFrame:
    """The log without undos and what they undid."""
    undone = log.where(F.col("kind") == "undo").select(F.col("undoes").alias("op")).distinct()
    return log.where(F.col("kind") != "undo").join(undone, "op", "left_anti")


def _last(kinds: tuple[str, ...], value: Column) -> Column:
    return F.max(F.when(F.col("kind").isin(*kinds), F.struct("op", value.alias("v"))))["v"]


def item_states(log: DataFrame) -> DataFrame:
    """(item, status, merged_into, touched, approved_op, ops) by replaying the log."""
    done = effective(log).groupBy("item").agg(
        F.coalesce(_last(STATUS, F.col("kind")), F.lit("restore")).alias("last"),
        _last(STATUS, F.when(F.col("kind") == "merge", F.col("other"))).alias("merged_into"),
        F.bool_or("by_user").alias("touched"),
        _last(("approve", "unapprove"), F.when(F.col("kind") == "approve", F.col("op"))).alias("approved_op"),
        F.count("*").alias("ops"),
    )
    status = F.when(F.col("last") == "dismiss", "dismissed").when(F.col("last") == "merge", "merged").otherwise("active")
    return done.select("item", status.alias("status"), "merged_into", "touched", "approved_op", "ops")


def locks(log: DataFrame) -> DataFrame:
    """(item, field, value) of fields that a user set and has not let go of: these values beat all observations."""
    last = effective(log).where(F.col("kind").isin("edit", "unlock")).groupBy("item", "field").agg(F.max(F.struct("op", "kind", "value")).alias("x"))
    return last.where("x.kind = 'edit'").select("item", "field", F.col("x.value").alias("value"))


def states_before(log: DataFrame) -> DataFrame:
    """(op, item, status, merged_into): each operation with what its item was just before, as the log then stood.

    An undo counts from its own place on, so what came later is not known to what came before. Each item's operations
    stream past in order, with a stack of those that set a state: what is undone by now never counts again, so it is
    taken off for good when it is met at the top. Every operation is put on and taken off once, however long the log.
    """
    undone_at = log.where(F.col("kind") == "undo").groupBy(F.col("undoes").alias("_u")).agg(F.min("op").alias("undone"))
    marked = log.join(undone_at, F.col("op") == F.col("_u"), "left").select("op", "item", "kind", "other", "undone")
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema}

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, live, fresh = None, None, [], []
        for batch in batches:
            status, into = [], []
            for op, item, kind, other, undone in zip(*(batch[c].to_pylist() for c in ("op", "item", "kind", "other", "undone")), strict=True):
                if item is None or item != at:
                    at, live, fresh = item, [], []
                elif op != last:
                    live += fresh
                    fresh = []
                last = op
                while live and live[-1][0] is not None and live[-1][0] <= op:
                    live.pop()
                _, now, kept = live[-1] if live else (None, "restore", None)
                status.append({"dismiss": "dismissed", "merge": "merged"}.get(now, "active"))
                into.append(kept if now == "merge" else None)
                if kind in STATUS and op is not None:
                    fresh.append((undone, kind, other))
            yield pa.RecordBatch.from_arrays([batch["op"], batch["item"], pa.array(status, pa.string()), pa.array(into, batch.schema.field("other").type)], ["op", "item", "status", "merged_into"])

    rows = marked.repartition("item").sortWithinPartitions("item", "op")
    return rows.mapInArrow(followed, f"op {kinds['op']}, item {kinds['item']}, status string, merged_into {kinds['other']}")


def undo_target(log: DataFrame) -> DataFrame:
    """(op, kind): the newest operation of a user that is not undone and no undo."""
    return effective(log).where("by_user").groupBy().agg(F.max(F.struct("op", "kind")).alias("x")).where("x is not null").select("x.*")


#: Rows of a chain of merges that are read before it is given up.
MOST_LINKS = 10


def survivors(states: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(item, live): the item at the end of an item's chain of merges, itself if it is not merged.

    Null where the chain has over ``most`` items (a circle has no end) or leads to an item that is gone. Pointers are
    composed, so a chain of ten takes four joins, all on one key.
    """
    hop = states.select("item", F.coalesce("merged_into", "item").alias("next"))
    at, reach, hops = states.select("item", F.col("item").alias("live")), hop, most - 1
    while hops:
        if hops & 1:
            at = at.join(reach.select(F.col("item").alias("live"), "next"), "live", "left").select("item", F.col("next").alias("live"))
        hops >>= 1
        if hops:
            reach = reach.join(reach.select(F.col("item").alias("next"), F.col("next").alias("_far")), "next", "left").select("item", F.col("_far").alias("next"))
    ends = states.where(F.col("merged_into").isNull()).select(F.col("item").alias("live"), F.lit(True).alias("_ends"))
    return at.join(ends, "live", "left").select("item", F.when(F.col("_ends"), F.col("live")).alias("live"))


def may(selected: DataFrame, key: str) -> DataFrame:
    """(key, approve, merge, dismiss, restore): what may be done to each selection of (key, item, status, needs_review) rows."""
    n, count = F.count("*"), lambda c: F.count(F.when(c, 1))
    status = F.col("status")
    return selected.groupBy(key).agg(
        (count(F.col("needs_review") & (status == "active")) == n).alias("approve"),
        ((n == 2) & (count(status != "merged") == 2)).alias("merge"),
        (count(status == "active") == n).alias("dismiss"),
        (count(status == "dismissed") == n).alias("restore"),
    )


def may_split(chosen: Column, every: Column) -> Column:
    """Whether the chosen sightings are some but not all of an item's."""
    known = F.size(F.array_intersect(chosen, every))
    return (known > 0) & (known == F.size(F.array_distinct(chosen))) & (known < F.size(F.array_distinct(every)))


def split(sightings: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sightings (item, sighting) after the chosen (sighting, new_item) have gone to new items, and the pairs to keep apart."""
    moved = sightings.join(chosen, "sighting", "left")
    after = moved.select(F.coalesce("new_item", "item").alias("item"), "sighting")
    pairs = moved.where("new_item is not null").select(F.least("item", "new_item").alias("item_a"), F.greatest("item", "new_item").alias("item_b")).distinct()
    return after, pairs


def approval_snapshot(title: Column, start: Column, end: Column, all_day: Column, due: Column) -> Column:
    """The fields an approval vouches for, as canonical JSON: names in order, times in whole seconds, nulls left out."""
    fields = F.struct(all_day.alias("allDay"), due.alias("due"), end.alias("end"), start.alias("start"), title.alias("title"))
    return F.to_json(fields, {"ignoreNullFields": "true"})


def edit_problem(field: Column, value: Column, start: Column) -> Column:
    """Why a value may not be set: null if it may. Times are seconds as text; ``start`` is the item's."""
    number = value.try_cast("long")
    time = field.isin("start", "end", "due", "remind")
    return (
        F.when((field == "title") & (F.trim(F.coalesce(value, F.lit(""))) == ""), "empty title")
        .when(time & value.isNotNull() & number.isNull(), "no time")
        .when((field == "end") & (number < start), "end before start")
        .when((field == "all_day") & ~F.coalesce(value, F.lit("")).isin("true", "false"), "neither true nor false")
        .when(~(time | field.isin("title", "place", "notes", "people", "all_day")), "unknown field")
    )
