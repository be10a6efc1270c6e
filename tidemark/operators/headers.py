"""Week and day views: which day each column's header shows, and which header a line stands under.

A header is a line with a weekday and a day number and no time (``Mon 12``), or two lines above each other (``12`` under ``Mon``).
The month comes from the header, else from the first line that names one, else from the nearest fitting day. Days between
two headers that the reading missed are put at even distances.

Lines are (image, n, text, x, y, w, h, parsed), pictures (image, today). A picture's few lines meet in one row where one choice
depends on another (stacked pairs); everything else is windows over a picture. Headers without a fitting day are left out;
a picture without headers has none; equal distances go to the header further left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_title, months_disagree, safe_date
from ..functions.text import fold
from .calendar import nearest_day

#: How far apart stacked lines may be, in heights and widths; days between two headers that are filled; headers needed.
REACH, SIDE, FILLED, LEAST_HEADERS = 2.5, 0.75, (2, 6), 3
HEADER = "array<struct<n:bigint,mx:double,my:double,weekday:int,day:int,month:int,year:int,late:int>>"


def _mid(x: str, w: str) -> Column:
    return F.col(x) + F.col(w) / 2


def stacked(numbers: Column, names: Column) -> Column:
    """Day numbers and weekday names above or below each other as headers; each number takes the nearest name that is left."""
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast(HEADER).alias("made"))

    def near(t: Column, used: Column) -> Column:
        fits = lambda s: (
            ~F.array_contains(used, s["n"]) & (F.abs(s["x"] - t["x"]) <= F.greatest(s["w"], t["w"]) * SIDE)
            & (F.abs(s["my"] - t["my"]) <= F.greatest(s["h"], t["h"]) * REACH) & (s["my"] != t["my"])
        )
        return F.array_min(F.transform(F.filter(names, fits), lambda s: F.struct(F.abs(s["my"] - t["my"]).alias("gap"), s["n"].alias("n"), s.alias("s"))))["s"]

    def joined(t: Column, s: Column) -> Column:
        middle = lambda at, size: (F.least(t[at], s[at]) + F.greatest(t[at] + t[size], s[at] + s[size])) / 2
        none = F.lit(None).cast("int")
        return F.struct(t["n"].alias("n"), middle("x", "w").alias("mx"), middle("y", "h").alias("my"), s["weekday"].alias("weekday"), t["day"].alias("day"), none.alias("month"), none.alias("year"), F.lit(1).alias("late"))

    def step(done: Column, t: Column) -> Column:
        taken = lambda s: F.when(s.isNull(), done).otherwise(
            F.struct(F.concat(done["used"], F.array(s["n"])).alias("used"), F.concat(done["made"], F.array(joined(t, s)).cast(HEADER)).alias("made"))
        )
        return F.transform(F.array(near(t, done["used"])), taken)[0]

    return F.aggregate(numbers, start, step)["made"]


def _candidates(lines: DataFrame) -> DataFrame:
    """(image, heads, hint): headers as read, and the first line that names a month, of each picture."""
    p, text = F.col("parsed"), F.trim("text")
    plain = p["hour"].isNull() & p["rel"].isNull()
    tuesday = F.regexp_extract(fold(text), r"^mar\.? (\d{1,2})$", 1)  # "mar 13" is a Tuesday too, and a header needs a weekday
    other = p["weekday"].isNull() & (tuesday != "")
    weekday, day = F.when(other, 2).otherwise(p["weekday"]), F.when(other, tuesday.try_cast("int")).otherwise(p["day"])
    month, year = (F.when(~other, p[c]) for c in ("month", "year"))
    head = F.struct("n", _mid("x", "w").alias("mx"), _mid("y", "h").alias("my"), weekday.alias("weekday"), day.alias("day"), month.alias("month"), year.alias("year"), F.lit(0).alias("late"))
    number = F.when(text.rlike("^[0-9]{1,2}$"), text.cast("int"))
    name = text.rlike(r"^[\p{L}.]{3,}$") & p["weekday"].isNotNull() & p["day"].isNull() & p["month"].isNull() & p["hour"].isNull()
    box = [F.col("n").alias("n"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("w").alias("w"), F.col("h").alias("h"), _mid("y", "h").alias("my")]
    written = F.coalesce(p["year"], F.nullif(F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int"))
    title = month_title(F.col("text"))
    says = F.when(title.isNotNull(), F.struct("n", title["month"].alias("month"), title["year"].alias("year"))).when(
        plain & weekday.isNull() & p["month"].isNotNull(), F.struct("n", p["month"].alias("month"), written.alias("year"))
    )
    met = lines.groupBy("image").agg(
        F.array_sort(F.collect_list(F.when(plain & weekday.isNotNull() & day.isNotNull() & title.isNull(), head))).alias("heads"),
        F.array_sort(F.collect_list(F.when(number.between(1, 31), F.struct(*box, number.alias("day"))))).alias("numbers"),
        F.array_sort(F.collect_list(F.when(name, F.struct(*box, p["weekday"].alias("weekday"))))).alias("names"),
        F.min(says).alias("says"),
    )
    return met.select("image", F.concat(F.col("heads").cast(HEADER), stacked(F.col("numbers"), F.col("names"))).alias("heads"), "says")


def _fitting_year(month: Column, day: Column, weekday: Column, today: Column) -> Column:
    """The day of that month and number nearest to today, in this year or one beside it; on the weekday if any is."""
    days = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: safe_date(F.year(today) + k, month, day)), lambda d: d.isNotNull())
    ranked = F.transform(days, lambda d: F.struct((F.weekday(d) + 1 != weekday).alias("off"), F.abs(F.date_diff(d, today)).alias("gap"), d.alias("d")))
    return F.array_min(ranked)["d"]


def _hinted(month: Column, year: Column, day: Column, weekday: Column, today: Column) -> Column:
    """The day of that number and weekday in the hinted month, else in the one before or after it."""
    first = safe_date(F.coalesce(year, F.year(_fitting_year(month, day, weekday, today)), F.year(today)), month, F.lit(1))
    months = F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda k: F.add_months(first, k))
    fit = F.filter(months, lambda m: (day <= F.dayofmonth(F.last_day(m))) & (F.weekday(F.date_add(m, day - 1)) + 1 == weekday))
    return F.date_add(F.get(fit, 0), day - 1)


def week_headers(lines: DataFrame, pictures: DataFrame) -> DataFrame:
    """(image, line, mid_x, mid_y, day, assumed, conflict); the line of a missed header is 0.

    ``assumed``: the month is neither written nor fits the one named, so the nearest such day was taken; ``conflict``: the months written
    in the picture cannot all be right.
    """
    rows = _candidates(lines).join(pictures, "image")
    told = F.filter("heads", lambda h: h["month"].isNotNull())
    months = F.transform(told, lambda h: F.struct(h["month"].alias("month"), h["year"].alias("year")))
    own = F.when(F.col("says").isNotNull(), F.array(F.struct("says.month", "says.year"))).otherwise(F.slice(months, 1, 0))
    rows = rows.select("image", "today", "heads", months_disagree(F.concat(own, months)).alias("conflict"), F.coalesce(F.when(F.col("says").isNotNull(), F.struct("says.month", "says.year")), F.get(months, 0)).alias("hint"))
    each = rows.select("image", "today", "conflict", "hint", F.inline("heads"))
    sure = (
        F.when(F.col("month").isNotNull() & F.col("year").isNotNull(), safe_date(F.col("year"), F.col("month"), F.col("day")))
        .when(F.col("month").isNotNull(), _fitting_year(F.col("month"), F.col("day"), F.col("weekday"), F.col("today")))
        .when(F.col("hint").isNotNull(), _hinted(F.col("hint.month"), F.col("hint.year"), F.col("day"), F.col("weekday"), F.col("today")))
    )
    dated = each.select("image", F.col("n").alias("line"), "mx", "my", "late", "conflict", sure.alias("sure"), nearest_day(F.col("today"), F.col("weekday"), F.col("day")).alias("near"))
    dated = dated.select("image", "line", "mx", "my", "late", "conflict", F.coalesce("sure", "near").alias("day"), F.col("sure").isNull().alias("assumed")).where("day is not null")
    order = Window.partitionBy("image").orderBy("mx", "late", "line")
    every = dated.withColumn("_count", F.count("*").over(Window.partitionBy("image"))).withColumn("_day", F.lead("day").over(order)).withColumn("_mx", F.lead("mx").over(order))
    gap = F.when((F.col("_count") >= LEAST_HEADERS) & F.date_diff("_day", "day").between(*FILLED), F.date_diff("_day", "day")).otherwise(1)
    spread = every.withColumn("_gap", gap).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
    at = F.col("mx") + F.when(F.col("_k") > 0, (F.col("_mx") - F.col("mx")) * F.col("_k") / F.col("_gap")).otherwise(0)
    return spread.select("image", F.when(F.col("_k") == 0, F.col("line")).otherwise(0).alias("line"), at.alias("mid_x"), F.col("my").alias("mid_y"), F.date_add("day", F.col("_k")).alias("day"), "assumed", "conflict")


def nearest_header(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(image, n, header, day): the header whose middle is nearest to each (image, n, mx) line's.

    One sorted sweep over both: the last header before a line and the first one after it; of equally near ones that on the left. No pairs are made.
    """
    heads = headers.select("image", F.col("mid_x").alias("mx"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), F.struct(F.col("mid_x").alias("x"), F.col("line").alias("header"), "day").alias("head"))
    both = heads.unionByName(lines.select("image", "mx", F.lit(1).alias("kind"), "n", F.lit(None).cast(heads.schema["head"].dataType).alias("head")))
    order = Window.partitionBy("image").orderBy("mx", "kind", F.col("head.header").desc())
    back = Window.partitionBy("image").orderBy(F.col("mx").desc(), F.col("kind"), F.col("head.header").desc())
    seen = both.withColumn("before", F.last("head", ignorenulls=True).over(order)).withColumn("after", F.last("head", ignorenulls=True).over(back)).where("kind = 1")
    left = F.col("after").isNull() | (F.col("mx") - F.col("before.x") <= F.col("after.x") - F.col("mx"))
    pick = F.when(F.col("before").isNotNull() & left, F.col("before")).otherwise(F.col("after"))
    return seen.withColumn("pick", pick).select("image", "n", F.col("pick.header").alias("header"), F.col("pick.day").alias("day"))
