"""Reference clocks: the moment that "today" and weekdays in a window are relative to.

A remote window's own strips (its top and bottom) are searched first, then the screen's menu bar, else the capture's time
stands. A clock over a day away from the capture is not believed. Where each strip's clock is found is one aggregation;
a screen's clock is read once for all its windows.

Lines are (shot, window, text, x, y, w, h, parsed), ``window`` null for what belongs to none; windows are (shot, window, remote, y, h, captured,
picture_height, per_window, window_only), ``captured`` a local time. Of equal places the first text counts; lines without a
time, or whose day does not exist, are no clocks; a null captured time gives a null instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import safe_date

#: Heights of the strips, as shares of the window and of the picture, and seconds that a clock may be away.
WINDOW_STRIP, SCREEN_STRIP, FAR = 0.06, 0.03, 24 * 3600


def _seconds(time: Column) -> Column:
    return F.unix_timestamp(time.cast("timestamp"))


def shown_instant(parsed: Column, captured: Column) -> Column:
    """The local time that a parsed clock shows; null if there is none.

    Without a day it is the capture's; a weekday and a number fit the capture's month, else the one before or after it; without a
    year it is the nearest year in which the day exists, on the weekday if one is written.
    """
    today, weekday, number = captured.cast("date"), parsed["weekday"], parsed["day"]
    clock = F.format_string(" %02d:%02d:00", parsed["hour"], F.coalesce(parsed["minute"], F.lit(0)))
    at = lambda day: F.concat(day.cast("string"), clock).try_cast("timestamp_ntz")
    on = lambda day: weekday.isNull() | (F.weekday(day) + 1 == weekday)
    beside = lambda fields: F.transform(F.array(*[F.lit(k) for k in (0, -1, 1)]), fields)
    months = F.filter(beside(lambda k: F.add_months(F.trunc(today, "month"), k)), lambda m: (number <= F.dayofmonth(F.last_day(m))) & (F.weekday(F.date_add(m, number - 1)) + 1 == weekday))
    years = F.filter(beside(lambda k: safe_date(F.year(today) + k, parsed["month"], number)), lambda d: d.isNotNull() & on(d))
    near = F.array_min(F.transform(years, lambda d: F.struct(F.abs(_seconds(at(d)) - _seconds(captured)).alias("gap"), d.alias("d"))))["d"]
    day = (
        F.when(number.isNull(), today)
        .when(parsed["month"].isNull(), F.when(weekday.isNotNull(), F.date_add(F.get(months, 0), number - 1)))
        .when(parsed["year"].isNull(), near)
        .otherwise(safe_date(parsed["year"], parsed["month"], number))
    )
    return F.when(parsed["hour"].between(0, 23) & parsed["rel"].isNull(), at(day))


def _first_clock(rows: DataFrame, *keys: str) -> DataFrame:
    """The first line of each key's that shows a clock, from top to bottom, then left to right."""
    told = rows.withColumn("_at", shown_instant(F.col("parsed"), F.col("captured"))).where("_at is not null")
    return told.groupBy(*keys).agg(F.min(F.struct(F.col("my"), F.col("x"), F.col("text"), F.col("_at").alias("at")))["at"].alias("at"))


def reference_clocks(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """(shot, window, instant, source, guess) of every window.

    Sources are ``window-clock``, ``screen-clock``, ``capture`` and ``capture-far-clock``. A far clock is a guess, and so is the capture's
    time of a screen whose windows are known; a picture of one window has no menu bar and is none.
    """
    lines = lines.withColumn("my", F.col("y") + F.col("h") / 2)
    frames = windows.where("remote").select("shot", "window", "captured", F.col("y").alias("_top"), (F.col("y") + F.col("h")).alias("_bottom"), (F.col("h") * WINDOW_STRIP).alias("_strip"))
    edge = (F.col("my") <= F.col("_top") + F.col("_strip")) | (F.col("my") >= F.col("_bottom") - F.col("_strip"))
    own = _first_clock(lines.join(frames, ["shot", "window"]).where(edge), "shot", "window").withColumnRenamed("at", "_own")
    screens = windows.where(~F.col("window_only")).select("shot", "captured", "picture_height", "per_window").distinct()
    bar = (F.col("my") <= F.col("picture_height") * SCREEN_STRIP) & (F.col("window").isNull() == F.col("per_window"))
    menu = _first_clock(lines.join(screens, "shot").where(bar), "shot").withColumnRenamed("at", "_menu")
    met = windows.join(own, ["shot", "window"], "left").join(menu, "shot", "left")
    menu_at = F.when(~F.col("window_only"), F.col("_menu"))
    at = F.coalesce("_own", menu_at)
    far = F.abs(_seconds(at) - _seconds(F.col("captured"))) > FAR
    source = F.when(at.isNull(), "capture").when(far, "capture-far-clock").when(F.col("_own").isNotNull(), "window-clock").otherwise("screen-clock")
    guess = F.when(at.isNull(), F.col("per_window") & ~F.col("window_only")).otherwise(far)
    return met.select("shot", "window", F.when(at.isNull() | far, F.col("captured")).otherwise(at).alias("instant"), source.alias("source"), guess.alias("guess"))
