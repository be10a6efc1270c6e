"""Absence detection: what covering captures no longer show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def absences(items: DataFrame, seen: DataFrame, covered: DataFrame) -> DataFrame:
    """(item, context, capture, at): captures whose span holds the item's moment, that do not show it.

    items: item, context, first_seen, moment; seen: item, context, capture, at; covered: context, capture, at,
    start, stop. Only items seen before the capture count. The join is on the context, its hits are filtered by the
    span before the anti-join; items of one context meet only the captures of it.
    """
    c = covered.select(F.col("context").alias("_c"), "capture", "at", "start", "stop")
    hit = items.join(c, (F.col("context") == F.col("_c")) & F.col("moment").between(F.col("start"), F.col("stop")) & (F.col("first_seen") < F.col("at"))).drop("_c")
    shown = seen.select("item", "context", "capture").distinct()
    return hit.join(shown, ["item", "context", "capture"], "left_anti").select("item", "context", "capture", "at")


def possibly_cancelled(absent: DataFrame, last: DataFrame, least: int = 2) -> DataFrame:
    """(item, context, absences) of items with ``least`` different captures without them since ``last_seen``."""
    since = absent.join(last, ["item", "context"]).where(F.col("at") > F.col("last_seen"))
    return since.groupBy("item", "context").agg(F.countDistinct("capture").alias("absences")).where(F.col("absences") >= least)
