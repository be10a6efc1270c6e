"""Items as they follow from what was seen of them, and the state of the library's files and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def recomputed(sightings: DataFrame, observed: DataFrame, touched: DataFrame) -> DataFrame:
    """One row for each item: kind, title, start, end, due, zone, day, first_seen, last_seen, sightings.

    sightings: item, sighting, at, kind, zone (name), offset (seconds from UTC); observed: item, sighting, field, value,
    source, at; touched: items that a user has touched. A field's value is what a user locked, else what was read, else
    what was inferred, the newest of these. The kind is the one seen most often, the latest of equals. The zone is that
    of the sighting which gave the time, else the latest one's; the day is the time's day there. An item without
    sightings goes unless a user has touched it. Both aggregates combine before their shuffle.
    """
    rank = F.when(F.col("source") == "user", 2).when(F.col("source") == "read", 1).otherwise(0)
    order = F.struct(rank.alias("r"), "at", "sighting")
    chosen = lambda f: F.max_by(F.struct("value", "sighting"), F.when(F.col("field") == f, order)).alias(f)
    fields = observed.where(F.col("value").isNotNull()).groupBy("item").agg(*[chosen(f) for f in ("title", "start", "end", "due")])
    kinds = sightings.groupBy("item", "kind").agg(F.count("*").alias("n"), F.max(F.struct("at", "sighting")).alias("last"))
    kind = kinds.groupBy("item").agg(F.max_by("kind", F.struct("n", "last")).alias("kind"))
    seen = sightings.groupBy("item").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("sightings"), F.max_by(F.struct("zone", "offset"), F.struct("at", "sighting")).alias("_latest")
    )
    every = seen.join(kind, "item").join(fields, "item", "full_outer").join(touched.select("item", F.lit(True).alias("_touched")).distinct(), "item", "left")
    every = every.where(F.col("sightings").isNotNull() | F.col("_touched"))
    given = F.coalesce(F.col("start.sighting"), F.col("due.sighting"))
    where = sightings.select(F.col("item").alias("_i"), F.col("sighting").alias("_s"), F.struct("zone", "offset").alias("_of_time"))
    told = every.withColumn("_given", given).join(where, (F.col("item") == F.col("_i")) & (F.col("_given") == F.col("_s")), "left")
    place, time = F.coalesce("_of_time", "_latest"), F.coalesce(F.col("start.value"), F.col("due.value")).cast("long")
    day = F.date_from_unix_date(F.floor((time + place["offset"]) / DAY).cast("int")).cast("string")
    return told.select(
        "item", "kind", F.col("title.value").alias("title"), *[F.col(f"{f}.value").cast("long").alias(f) for f in ("start", "end", "due")], place["zone"].alias("zone"), day.alias("day"),
        "first_seen", "last_seen", F.coalesce("sightings", F.lit(0)).cast("long").alias("sightings"),
    )


def review(title_changed: Column, confidence: Column, chosen_inferred: Column, absences: Column, duplicate: Column, least: float = 0.6) -> Column:
    """Why an item waits for its user, as an array of reasons in a fixed order; empty if it does not."""
    tests = [("changed-after-approval", title_changed), ("low-confidence", confidence < least), ("inferred-time", chosen_inferred), ("possibly-cancelled", absences >= 2), ("possible-duplicate", duplicate)]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests]))


def file_state(files: DataFrame, images: DataFrame) -> DataFrame:
    """(image, state): files that no row names are orphans, rows whose file is gone are missing, and back once it is there."""
    both = files.select("image", F.lit(True).alias("_f")).distinct().join(images.select("image", "missing"), "image", "full_outer")
    state = (
        F.when(F.col("missing").isNull(), "orphan").when(F.col("_f").isNull() & ~F.col("missing"), "now missing")
        .when(F.col("_f") & F.col("missing"), "found again").when(F.col("_f").isNull(), "missing").otherwise("stored")
    )
    return both.select("image", state.alias("state"))


def to_cut(sightings: DataFrame, cutouts: DataFrame, version: int) -> DataFrame:
    """(sighting, why): sightings without a cut-out, and those whose cut-out is of an older geometry, which go first."""
    newest = cutouts.groupBy("sighting").agg(F.max("version").alias("_v"))
    why = F.when(F.col("_v") < version, "older").when(F.col("_v").isNull(), "none")
    return sightings.join(newest, "sighting", "left").select("sighting", why.alias("why")).where("why is not null")


def cleanup(images: DataFrame, chosen: DataFrame) -> DataFrame:
    """(events, images, bytes): what removing the chosen events would take away."""
    gone = images.join(chosen.select("event").distinct(), "event", "left_semi")
    return gone.agg(F.countDistinct("event").alias("events"), F.count("*").alias("images"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def context_problems(contexts: DataFrame) -> DataFrame:
    """(context, problem): names that are empty or taken (whatever their case) by an earlier context, and hints of one letter."""
    from pyspark.sql import Window

    first = F.min("context").over(Window.partitionBy(F.lower(F.trim("name"))))
    named = contexts.withColumn("_first", first)
    problem = (
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no name").when(F.col("_first") < F.col("context"), "name taken")
        .when(F.exists("hints", lambda h: F.length(F.trim(h)) < 2), "hint too short")
    )
    return named.select("context", problem.alias("problem")).where("problem is not null")


def replaced_lines(stored: DataFrame, read: DataFrame, images: DataFrame) -> DataFrame:
    """The library's lines after the images were read again: theirs are replaced whole, also by none; others stay."""
    return stored.join(images.select("image").distinct(), "image", "left_anti").unionByName(read.join(images.select("image").distinct(), "image", "left_semi"))
