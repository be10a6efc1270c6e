"""Dates in texts: parsing, and resolution against a reference day."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of weekdays and months, folded, in English and Spanish; French and German for our texts.
WEEKDAYS = {
    "monday": 1, "mon": 1, "lunes": 1, "lun": 1, "lundi": 1, "montag": 1,
    "tuesday": 2, "tue": 2, "tues": 2, "martes": 2, "mar": 2, "mardi": 2, "dienstag": 2,
    "wednesday": 3, "wed": 3, "weds": 3, "miercoles": 3, "mie": 3, "mercredi": 3, "mittwoch": 3,
    "thursday": 4, "thu": 4, "thur": 4, "thurs": 4, "jueves": 4, "jue": 4, "jeudi": 4, "donnerstag": 4,
    "friday": 5, "fri": 5, "viernes": 5, "vie": 5, "vendredi": 5, "freitag": 5,
    "saturday": 6, "sat": 6, "sabado": 6, "sab": 6, "samedi": 6, "samstag": 6,
    "sunday": 7, "sun": 7, "domingo": 7, "dom": 7, "dimanche": 7, "sonntag": 7,
}
MONTHS = {
    "january": 1, "jan": 1, "enero": 1, "ene": 1, "janvier": 1, "januar": 1,
    "february": 2, "feb": 2, "febrero": 2, "fevrier": 2, "februar": 2,
    "march": 3, "mar": 3, "marzo": 3, "mars": 3, "marz": 3,
    "april": 4, "apr": 4, "abril": 4, "abr": 4, "avril": 4,
    "may": 5, "mayo": 5, "mai": 5,
    "june": 6, "jun": 6, "junio": 6, "juin": 6, "juni": 6,
    "july": 7, "jul": 7, "julio": 7, "juillet": 7, "juli": 7,
    "august": 8, "aug": 8, "agosto": 8, "ago": 8, "aout": 8,
    "september": 9, "sep": 9, "sept": 9, "septiembre": 9, "setiembre": 9, "septembre": 9,
    "october": 10, "oct": 10, "octubre": 10, "octobre": 10, "oktober": 10,
    "november": 11, "nov": 11, "noviembre": 11, "novembre": 11,
    "december": 12, "dec": 12, "diciembre": 12, "dic": 12, "decembre": 12, "dezember": 12,
}
#: Countries that write the month, or the year, first.
MONTH_FIRST, YEAR_FIRST = ("US", "PH"), ("JP", "CN", "KR", "TW", "HU", "LT")

PARSED = "struct<weekday:int,day:int,month:int,year:int,hour:int,minute:int,rel:string,rel_n:int,order_assumed:boolean>"
_marks = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
_week = "|".join(sorted(WEEKDAYS, key=len, reverse=True))
_month = "|".join(sorted(MONTHS, key=len, reverse=True))
_rules = {
    "next": re.compile(rf"\b(?:next|proximo|proxima) ({_week})\b|\b({_week}) que viene\b"),
    "end": re.compile(r"\bend of (?:the )?week\b|\bfin de (?:la )?semana\b"),
    "days": re.compile(r"\b(?:in|en) (\d{1,3}) (?:days?|dias?)\b"),
    "today": re.compile(r"\b(?:today|hoy)\b"),
    "tomorrow": re.compile(r"\btomorrow\b|(?<!la )\bmanana\b"),
    "yesterday": re.compile(r"\b(?:yesterday|ayer)\b"),
}
_clock = re.compile(r"\b(\d{1,2})(?::(\d{2})(?::\d{2})?|h(\d{2}))\s?([ap])?\.?(?:m\b\.?)?|\b(\d{1,2})\s?([ap])\.?m\b\.?")
_iso = re.compile(r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b")
_numeric = re.compile(r"\b(\d{1,2})[-/.](\d{1,2})(?:[-/.](\d{4}|\d{2}))?\b")
_day_first = re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th|o)? ?(?:de |of )?({_month})\b\.?(?:,? (?:de )?(\d{{4}}))?")
_month_first = re.compile(rf"\b({_month})\b\.? (\d{{1,2}})(?:st|nd|rd|th)?\b(?:,? (\d{{4}}))?")
_weekday = re.compile(rf"\b({_week})\b\.?(?:,? (?:(?:el|the|on) )?(\d{{1,2}})(?:st|nd|rd|th)?\b(?! ?[-:/\d]))?")


def parse_text(text: str | None, order: str = "dmy") -> dict | None:
    """What a text says of a date: relative words, then the clock, then the date, then the weekday.

    What one rule has read is blanked out for the next. None if no rule finds anything.
    """
    rest = " ".join((text or "").lower().translate(_marks).split())
    found: dict = {}

    def take(match: re.Match) -> None:
        nonlocal rest
        rest = rest[: match.start()] + " " * (match.end() - match.start()) + rest[match.end() :]

    for rule, pattern in _rules.items():
        if match := pattern.search(rest):
            found["rel"] = rule
            if rule == "next":
                found["rel_n"] = WEEKDAYS[match[1] or match[2]]
            if rule == "days":
                found["rel_n"] = int(match[1])
            take(match)
            break
    for match in _clock.finditer(rest):
        hour, minute, half = int(match[1] or match[5]), int(match[2] or match[3] or 0), match[4] or match[6]
        if hour > 23 or minute > 59 or (half and not 1 <= hour <= 12):
            continue
        found |= {"hour": hour % 12 + 12 * (half == "p") if half else hour, "minute": minute}
        take(match)
        break
    for read in (_read_iso, _read_named, lambda r: _read_numeric(r, order)):
        if got := read(rest):
            match, values = got
            found |= values
            take(match)
            break
    if match := _weekday.search(rest):
        found["weekday"] = WEEKDAYS[match[1]]
        if match[2] and "day" not in found and 1 <= int(match[2]) <= 31:
            found["day"] = int(match[2])
    return {"order_assumed": False, **found} if found else None


def _read_iso(rest: str):
    for m in _iso.finditer(rest):
        if 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31:
            return m, {"year": int(m[1]), "month": int(m[2]), "day": int(m[3])}


def _read_named(rest: str):
    for pattern, day, month in ((_day_first, 1, 2), (_month_first, 2, 1)):
        for m in pattern.finditer(rest):
            if 1 <= int(m[day]) <= 31:
                return m, {"day": int(m[day]), "month": MONTHS[m[month]]} | ({"year": int(m[3])} if m[3] else {})


def _read_numeric(rest: str, order: str):
    for m in _numeric.finditer(rest):
        a, b, c = int(m[1]), int(m[2]), int(m[3]) if m[3] else None
        sure = "dmy" if a > 12 >= b else "mdy" if b > 12 >= a else None
        day, month, year = {"dmy": (a, b, c), "mdy": (b, a, c), "ymd": (c, b, a)}[sure or order]
        if day is not None and 1 <= month <= 12 and 1 <= day <= 31:
            year = year + 2000 * (year < 100) if year is not None else None
            return m, {"day": day, "month": month, "order_assumed": sure is None} | ({"year": year} if year else {})


def usual_order(country: str | None) -> str:
    return "mdy" if country in MONTH_FIRST else "ymd" if country in YEAR_FIRST else "dmy"


def parse(rows: DataFrame, text: str = "text", order: str = "dmy") -> DataFrame:
    """Adds ``parsed``; null where a text says nothing of a date."""
    names = [part.split(":")[0] for part in PARSED[7:-1].split(",")]

    @F.pandas_udf(PARSED[7:-1].replace(":", " "))
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [parse_text(t, order) or {} for t in texts]
            out = pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype="object") for n in names})
            for n in names:
                out[n] = out[n].astype("string" if n == "rel" else "boolean" if n == "order_assumed" else "Int32")
            yield out

    return rows.withColumn("parsed", parsed(F.col(text))).withColumn("parsed", F.when(F.coalesce(*[F.col(f"parsed.{n}").cast("string") for n in names]).isNotNull(), F.col("parsed")))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date; null if there is no such day."""
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")).try_cast("date")


def month_index(month: Column, shift: Column) -> Column:
    """The first day of the month ``shift`` months from the month of a date."""
    return F.add_months(F.trunc(month, "month"), shift)


def month_title(text: Column) -> Column:
    """(month, year) of a line that only names a month, with or without a year; null otherwise.

    Six words at most, all of them months, years or "de", "del", "of"; without a year one word has to be a whole name.
    """
    from .text import fold

    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    words = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    month = lambda w: F.try_element_at(months, w)
    is_year = lambda w: w.rlike("^(19[9][0-9]|20[0-9]{2}|2100)$")
    fits = F.forall(words, lambda w: month(w).isNotNull() | is_year(w) | w.isin("de", "del", "of"))
    found, year = F.get(F.filter(F.transform(words, month), lambda m: m.isNotNull()), 0), F.get(F.filter(words, is_year), 0).cast("int")
    whole = year.isNotNull() | F.exists(words, lambda w: (F.length(w) >= 5) | w.isin("june", "july", "mayo"))
    return F.when(F.size(words).between(1, 6) & fits & found.isNotNull() & whole, F.struct(found.alias("month"), year.alias("year")))


def months_disagree(months: Column) -> Column:
    """Whether two of an array of (month, year) cannot belong to one view: over a month apart, counted round the year where a year is missing."""
    def apart(a: Column, b: Column) -> Column:
        gap = F.abs(a["month"] - b["month"])
        known = F.abs((a["year"] * 12 + a["month"]) - (b["year"] * 12 + b["month"]))
        return F.coalesce(known, F.least(gap, 12 - gap)) > 1

    return F.exists(months, lambda a: F.exists(months, lambda b: apart(a, b)))


def next_weekday(today: Column, weekday: Column) -> Column:
    """The next such weekday after today, 1 to 7 days ahead."""
    ahead = F.pmod(weekday - (F.weekday(today) + 1) - 1, F.lit(7)) + 1
    return F.date_add(today, ahead.cast("int"))


def end_of_week(today: Column) -> Column:
    """This week's Friday; on weekends the next one."""
    return F.date_add(today, F.pmod(F.lit(4) - F.weekday(today), F.lit(7)).cast("int"))


def weekday_ahead(today: Column, weekday: Column) -> Column:
    """Such a weekday from today on, today included."""
    return F.date_add(today, F.pmod(weekday - (F.weekday(today) + 1), F.lit(7)).cast("int"))


def nearest_year(month: Column, day: Column, today: Column) -> Column:
    """The date of that month and day closest to today, in this year or a neighbouring one."""
    years = F.array(*[safe_date(F.year(today) + k, month, F.least(day, F.lit(28))) for k in (-1, 0, 1)])
    ranked = F.array_sort(F.transform(years, lambda d: F.struct(F.abs(F.date_diff(d, today)).alias("gap"), F.year(d).alias("year"))))
    return safe_date(ranked[0]["year"], month, day)


def resolve(parsed: Column, today: Column) -> Column:
    """The day a parsed text means, seen from ``today``; null if it names none."""
    p = parsed
    return (
        F.when(p["rel"] == "today", today).when(p["rel"] == "tomorrow", F.date_add(today, 1)).when(p["rel"] == "yesterday", F.date_add(today, -1))
        .when(p["rel"] == "days", F.date_add(today, p["rel_n"])).when(p["rel"] == "next", next_weekday(today, p["rel_n"])).when(p["rel"] == "end", end_of_week(today))
        .when(p["year"].isNotNull(), safe_date(p["year"], p["month"], p["day"]))
        .when(p["month"].isNotNull(), nearest_year(p["month"], p["day"], today))
        .when(p["weekday"].isNotNull(), weekday_ahead(today, p["weekday"])).when(p["hour"].isNotNull(), today)
    )


def presets(today: str) -> dict[str, tuple[str, str]]:
    """First and last second of each preset range around a day."""
    d = date.fromisoformat(today)
    month_end = (d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    days = {"today": (d, d), "last7": (d - timedelta(6), d), "last30": (d - timedelta(29), d), "month": (d.replace(day=1), month_end), "next30": (d, d + timedelta(29))}
    return {k: (f"{a} 00:00:00", f"{b} 23:59:59") for k, (a, b) in days.items()}


def custom_range(start: str, end: str) -> tuple[str, str]:
    """Whole days, swapped if reversed."""
    a, b = sorted((start, end))
    return f"{a} 00:00:00", f"{b} 23:59:59"
