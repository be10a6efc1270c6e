"""Survivorship: which observation gives an item's field."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_fields(observed: DataFrame) -> DataFrame:
    """(item, field, value, source) of (item, field, value, source, confidence, at, seq) observations.

    What was read beats what was inferred; then the newest wins, and of equals the greatest value, however the rows are
    stored. This part of the rule is an order, so it is an aggregate that combines before the shuffle.
    ``resolve_pairwise`` has the whole rule.
    """
    best = F.max(F.struct((F.col("source") == "read").cast("int").alias("r"), "at", "seq", "value", "source"))
    return observed.where(F.col("value").isNotNull()).groupBy("item", "field").agg(best.alias("x")).select("item", "field", "x.value", "x.source")


def better(a: dict, b: dict, field: str) -> bool:
    """Whether the older observation ``a`` replaces the newer ``b``."""
    if (a["source"] == "read") != (b["source"] == "read"):
        return a["source"] == "read"
    if field == "title":
        x, y = str(a["value"]).rstrip("…. "), str(b["value"]).rstrip("…. ")
        if x != y and (x.startswith(y) or y.startswith(x)):
            return len(x) > len(y)
    if field in ("start", "end") and bool(a.get("all_day")) != bool(b.get("all_day")):
        return not a.get("all_day")
    if abs(a["confidence"] - b["confidence"]) >= 0.1:
        return a["confidence"] > b["confidence"]
    x, y = str(a["value"]), str(b["value"])
    return len(x) > len(y) and x.startswith(y)


def resolve_pairwise(observed: DataFrame) -> DataFrame:
    """The whole rule, with locks (source ``user``): values are compared pair by pair from the newest on.

    The gap of 0.1 in confidence makes the rule no order, so observations of one field go through it in turn. A field
    has as many observations as its item has sightings; they arrive sorted and are folded one at a time, so no task
    holds them together.
    """
    keys = ["item", "field"]
    ordered = observed.repartition(*keys).sortWithinPartitions("item", "field", F.col("at").desc(), F.col("seq").desc())

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best, locked = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if (row["item"], row["field"]) != at:
                    if at is not None and (locked or best):
                        out.append({**(locked or best), "item": at[0], "field": at[1]})
                    at, best, locked = (row["item"], row["field"]), None, None
                if row["source"] == "user":
                    locked = locked or row
                elif row["value"] is not None and (best is None or better(row, best, row["field"])):
                    best = row
            if out:
                yield pd.DataFrame(out)[["item", "field", "value", "source"]]
        if at is not None and (locked or best):
            yield pd.DataFrame([{**(locked or best), "item": at[0], "field": at[1]}])[["item", "field", "value", "source"]]

    return ordered.mapInPandas(folded, "item long, field string, value string, source string")


def people_union(rows: DataFrame) -> DataFrame:
    """(item, people): names oldest first, each once whatever its case, in the spelling seen first."""
    first = rows.groupBy("item", F.lower(F.trim("person")).alias("form")).agg(F.min(F.struct("at", "seq", "person")).alias("x")).where("form <> ''")
    names = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["person"])
    return first.groupBy("item").agg(F.array_join(names, ", ").alias("people"))


def alias_spellings(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item, spelling): each other form of an item's title, as spelled first."""
    first = rows.groupBy("item", "form").agg(F.min_by("spelling", "at").alias("spelling"))
    return first.join(chosen, "item").where(F.col("form") != F.col("chosen")).select("item", "spelling")


