"""Rectangles as structs (x, y, w, h), top-left origin: intersection, occlusion, suppression, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import spread


def overlap_area(a: Column, b: Column) -> Column:
    """Area of the intersection; 0 if there is none."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def holds(box: Column, x: Column, y: Column) -> Column:
    """Whether the point lies in the box; right and bottom edges do not belong to it."""
    return (x >= box["x"]) & (x < box["x"] + box["w"]) & (y >= box["y"]) & (y < box["y"] + box["h"])


def clip(a: Column, b: Column) -> Column:
    """The intersection, or null."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w, h = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x, F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return F.when((w > 0) & (h > 0), F.named_struct(F.lit("x"), x, F.lit("y"), y, F.lit("w"), w, F.lit("h"), h))


def frontmost(points: DataFrame, windows: DataFrame) -> DataFrame:
    """(image, line, window): the frontmost window of the image that holds the line's centre."""
    w = windows.select(F.col("image").alias("_i"), "window", "stack", "box")
    hit = points.join(w, (F.col("image") == F.col("_i")) & holds(F.col("box"), F.col("cx"), F.col("cy")))
    return hit.groupBy("image", "line").agg(F.min_by("window", F.struct("stack", "window")).alias("window"))


def cut(frame: tuple, other: tuple) -> list[tuple]:
    """What is left of a frame behind another: four disjoint rectangles at most."""
    x, y, w, h = frame
    left, top = max(x, other[0]), max(y, other[1])
    right, bottom = min(x + w, other[0] + other[2]), min(y + h, other[1] + other[3])
    if left >= right or top >= bottom:
        return [frame]
    parts = [(x, y, w, top - y), (x, bottom, w, y + h - bottom), (x, top, left - x, bottom - top), (right, top, x + w - right, bottom - top)]
    return [p for p in parts if p[2] > 0 and p[3] > 0]


def visible(windows: DataFrame) -> DataFrame:
    """(image, window, share): how much of each window no window in front of it covers.

    Windows of an image, front to back, stream through a task; an image has as many as a screen shows.
    """
    ordered = windows.select("image", "stack", "window", "box.x", "box.y", "box.w", "box.h").repartition("image").sortWithinPartitions("image", "stack", "window")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, front = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.image != at:
                    at, front = r.image, []
                frame = (r.x, r.y, r.w, r.h)
                rest = [frame]
                for other in front:
                    rest = [p for part in rest for p in cut(part, other)]
                out.append((r.image, r.window, sum(p[2] * p[3] for p in rest) / max(1, r.w * r.h)))
                front.append(frame)
            yield pd.DataFrame(out, columns=["image", "window", "share"])

    return ordered.mapInPandas(seen, "image long, window long, share double")


def suppressed(boxes: DataFrame) -> DataFrame:
    """(image, id): boxes left when the widest, then surest, drop those they overlap by half the smaller or more."""
    ordered = boxes.select("image", "id", "confidence", "box.x", "box.y", "box.w", "box.h").repartition("image").sortWithinPartitions("image", F.col("w").desc(), F.col("confidence").desc(), "id")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, taken = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.image != at:
                    at, taken = r.image, []
                area = r.w * r.h
                for x, y, w, h in taken:
                    shared = max(0, min(x + w, r.x + r.w) - max(x, r.x)) * max(0, min(y + h, r.y + r.h) - max(y, r.y))
                    if 2 * shared >= min(area, w * h):
                        break
                else:
                    taken.append((r.x, r.y, r.w, r.h))
                    out.append((r.image, r.id))
            yield pd.DataFrame(out, columns=["image", "id"])

    return ordered.mapInPandas(kept, "image long, id long")


def reading_order(lines: DataFrame) -> DataFrame:
    """(image, id, place): by rows, then from left to right; a row starts where a top is over half the median height
    below the one before."""
    shared, each = Window.partitionBy("image"), spread(lines, "image")
    height = F.col("box.h")
    ranked = each.withColumn("_k", F.row_number().over(shared.orderBy(height.asc_nulls_last()))).withColumn("_n", F.count("*").over(shared))
    down = shared.orderBy("box.y", "box.x", "id")
    m = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, height)).over(shared)
    broken = ranked.withColumn("m", m).withColumn("new", (F.col("box.y") - F.coalesce(F.lag("box.y").over(down), F.col("box.y")) > F.col("m") / 2).cast("int"))
    rows = broken.withColumn("row", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("image", "id", F.row_number().over(Window.partitionBy("image").orderBy("row", "box.x", "box.y", "id")).cast("long").alias("place"))


def evidence_region(box: Column, width: int, height: int) -> Column:
    """The box with a margin of 15 % (24 pixels at least) inside the picture."""
    mx, my = F.greatest(F.lit(24), F.floor(box["w"] * 0.15)), F.greatest(F.lit(24), F.floor(box["h"] * 0.15))
    x, y = F.greatest(F.lit(0), box["x"] - mx), F.greatest(F.lit(0), box["y"] - my)
    return F.struct(
        x.cast("long").alias("x"), y.cast("long").alias("y"), (F.least(F.lit(width), box["x"] + box["w"] + mx) - x).cast("long").alias("w"), (F.least(F.lit(height), box["y"] + box["h"] + my) - y).cast("long").alias("h")
    )


def selected_windows(windows: DataFrame, most: int = 20) -> DataFrame:
    """(image, window, stack, box): frames clipped to the picture (width, height), empty ones gone, the largest first, ties front to back, then by their boxes, however they are stored."""
    inside = windows.withColumn("box", clip(F.col("box"), F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h")))).where("box is not null")
    largest = Window.partitionBy("image").orderBy((F.col("box.w") * F.col("box.h")).desc(), "stack", "window", "box")
    return inside.withColumn("_n", F.row_number().over(largest)).where(F.col("_n") <= most).select("image", "window", "stack", "box")


def outline(frame: Column, display: Column) -> Column:
    """The part of a frame on a display, in the display's own coordinates; null if it is not there."""
    part = clip(frame, display)
    return F.when(part.isNotNull(), F.struct((part["x"] - display["x"]).alias("x"), (part["y"] - display["y"]).alias("y"), part["w"].alias("w"), part["h"].alias("h")))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A box in fractions from the bottom left as whole pixels from the top left, rounded outward, inside the picture, not empty."""
    tiny = 1e-6
    within = lambda v, low, high: F.greatest(low, F.least(high.cast("double"), v))
    zero = F.lit(0.0)
    left = within(F.floor(box["x"] * width + tiny), zero, width)
    right = within(F.ceil((box["x"] + box["w"]) * width - tiny), left, width)
    top = within(F.floor((1 - (box["y"] + box["h"])) * height + tiny), zero, height)
    bottom = within(F.ceil((1 - box["y"]) * height - tiny), top, height)
    whole = lambda v: v.cast("long")
    return F.struct(whole(left).alias("x"), whole(top).alias("y"), F.greatest(F.lit(1), whole(right - left)).alias("w"), F.greatest(F.lit(1), whole(bottom - top)).alias("h"))
