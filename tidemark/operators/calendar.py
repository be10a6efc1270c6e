"""Calendar views: hour scales, coverage spans, reminders, strict edits and date texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOCK_LABEL = r"(?i)^\s*([0-9]{1,2})(?::([0-9]{2}))?\s*([ap])?\.?m?\.?\s*$"
#: Fixed values of the coverage rule: labels, evenness of their distances, hours covered.
LEAST_LABELS, UNEVEN, LEAST_HOURS = 3, 1.2, 2


def label_hour(text: Column) -> Column:
    """The hour of a clock label such as ``15:00``, ``3 PM`` or ``9``; null for other texts."""
    hour = F.try_to_number(F.nullif(F.regexp_extract(text, CLOCK_LABEL, 1), F.lit("")), F.lit("99")).cast("int")
    half = F.lower(F.regexp_extract(text, CLOCK_LABEL, 3))
    full = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when(full <= 23, full)


def hour_scales(labels: DataFrame) -> DataFrame:
    """(image, first_hour, last_hour, labels) of (image, y, text) lines whose clock labels make a scale.

    From top to bottom bare hours that fall back count on by twelve. There must be three labels or more, two hours
    or more, and the distances of neighbours may differ by a fifth.
    """
    down = Window.partitionBy("image").orderBy("y")
    rows = labels.withColumn("hour", label_hour(F.col("text"))).where(F.col("hour").isNotNull())
    rows = rows.withColumn("_back", (F.col("hour") < F.coalesce(F.lag("hour").over(down), F.col("hour"))).cast("int"))
    rows = rows.withColumn("hour", F.col("hour") + 12 * F.sum("_back").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_step", (F.col("y") - F.lag("y").over(down)) / F.nullif(F.col("hour") - F.lag("hour").over(down), F.lit(0)))
    scale = rows.groupBy("image").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("labels"), F.max("_step").alias("_most"), F.min("_step").alias("_least"))
    even = (F.col("_least") > 0) & (F.col("_most") <= UNEVEN * F.col("_least"))
    return scale.where((F.col("labels") >= LEAST_LABELS) & even & (F.col("last_hour") - F.col("first_hour") >= LEAST_HOURS) & (F.col("last_hour") <= 24)).drop("_most", "_least")


def coverage_spans(scales: DataFrame, days: DataFrame) -> DataFrame:
    """(image, day, start, stop): what a view covers of each of its visible days, closed at both ends."""
    both = scales.join(days, "image")
    at = lambda c: F.timestamp_add("HOUR", F.col(c), F.col("day").cast("timestamp_ntz"))
    return both.select("image", "day", at("first_hour").alias("start"), at("last_hour").alias("stop"))


def working_day_before(day: Column) -> Column:
    """The last working day before a day."""
    return F.date_add(day, F.when(F.weekday(day) == 0, -3).when(F.weekday(day) == 6, -2).otherwise(-1).cast("int"))


def strict_edit(text: Column) -> Column:
    """A time typed as ``yyyy-MM-dd HH:mm`` or ``yyyy-MM-dd``; null for anything else."""
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), F.concat(text, F.lit(":00"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit(" 00:00:00")))
    return whole.try_cast("timestamp_ntz")


def nearest_day(today: Column, weekday: Column, number: Column) -> Column:
    """The day with that weekday and number closest to today, within half a year; the earlier of two."""
    days = F.sequence(F.date_add(today, -183), F.date_add(today, 183))
    fit = F.filter(days, lambda d: (F.weekday(d) + 1 == weekday) & (F.dayofmonth(d) == number))
    return F.array_min(F.transform(fit, lambda d: F.struct(F.abs(F.date_diff(d, today)).alias("gap"), d.alias("day"))))["day"]
