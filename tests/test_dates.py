"""Date texts and what they say, and days that do not exist."""

import datetime

import pytest

from tidemark.functions import dates as D

#: (text, what it says, order); days of the week count from Monday.
CASES = [
    ("Friday 23 October", dict(weekday=5, day=23, month=10)), ("Friday 23 October 2026", dict(weekday=5, day=23, month=10, year=2026)), ("Oct 14", dict(day=14, month=10)),
    ("October 14th, 2026", dict(day=14, month=10, year=2026)), ("14 Oct", dict(day=14, month=10)), ("Wed 14", dict(weekday=3, day=14)), ("Mon 12", dict(weekday=1, day=12)),
    ("1st November", dict(day=1, month=11)), ("March 3rd", dict(day=3, month=3)), ("Sept. 9", dict(day=9, month=9)), ("Thursday, October 15, 2026", dict(weekday=4, day=15, month=10, year=2026)),
    ("Wednesday, 14 October 2026 at 09:12", dict(weekday=3, day=14, month=10, year=2026, hour=9, minute=12)), ("2026-11-06", dict(day=6, month=11, year=2026)),
    ("14/10/2026", dict(day=14, month=10, year=2026)), ("10/14/2026", dict(day=14, month=10, year=2026)), ("14/10", dict(day=14, month=10)), ("10/14", dict(day=14, month=10)),
    ("03/04", dict(day=4, month=3, order_assumed=True), "mdy"), ("03/04", dict(day=3, month=4, order_assumed=True)), ("4/5/26", dict(day=5, month=4, year=2026, order_assumed=True), "mdy"),
    ("26/10/11", dict(day=26, month=10, year=2011)), ("10/9/11", dict(day=11, month=9, year=2010, order_assumed=True), "ymd"),
    ("10:00", dict(hour=10, minute=0)), ("9:30 AM", dict(hour=9, minute=30)), ("2:15 PM", dict(hour=14, minute=15)), ("12 PM", dict(hour=12, minute=0)), ("12 AM", dict(hour=0, minute=0)),
    ("5pm", dict(hour=17, minute=0)), ("10:00 - 11:30", dict(hour=10, minute=0)), ("a las 15:00", dict(hour=15, minute=0)), ("15h30", dict(hour=15, minute=30)),
    ("tomorrow at 10:00", dict(hour=10, minute=0, rel="tomorrow")), ("today", dict(rel="today")), ("yesterday", dict(rel="yesterday")), ("in 2 days", dict(rel="days", rel_n=2)),
    ("next Monday", dict(rel="next", rel_n=1)), ("by the end of the week", dict(rel="end")), ("mañana a las 15:00", dict(hour=15, minute=0, rel="tomorrow")), ("hoy", dict(rel="today")),
    ("en 3 días", dict(rel="days", rel_n=3)), ("el próximo lunes", dict(rel="next", rel_n=1)), ("el lunes que viene", dict(rel="next", rel_n=1)), ("fin de semana", dict(rel="end")),
    ("14 de octubre de 2026", dict(day=14, month=10, year=2026)), ("viernes 23 de octubre", dict(weekday=5, day=23, month=10)), ("mié 14", dict(weekday=3, day=14)),
    ("miércoles, 14 de octubre de 2026, 09:12", dict(weekday=3, day=14, month=10, year=2026, hour=9, minute=12)), ("sábado 17 oct.", dict(weekday=6, day=17, month=10)),
    ("15 de enero", dict(day=15, month=1)), ("el viernes", dict(weekday=5)), ("by Friday", dict(weekday=5)), ("mar", dict(weekday=2)),
    ("Team sync", None), ("Room 4", None), ("4 people", None), ("", None), ("   ", None), (None, None),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: str(c[0]))
def test_texts(case):
    text, want, order = (*case, "dmy")[:3]
    got = D.parse_text(text, order)
    assert got == (want if want is None else {"order_assumed": False, **want})


def test_days_that_do_not_exist(spark):
    today = datetime.date(2026, 3, 10)
    rows = D.parse(spark.createDataFrame([("31 feb", today), ("31/02/2026", today), ("29 feb", today), ("28 feb", today)], "text string, today date"))
    got = [r.d for r in rows.select(D.resolve(rows.parsed, rows.today).alias("d")).collect()]
    assert got == [None, None, None, datetime.date(2026, 2, 28)]


def test_month_titles(spark):
    rows = spark.createDataFrame([("Febrero de 2026",), ("October 2026",), ("octubre",), ("oct",), ("October meeting",), ("",)], "text string")
    got = [r.m and tuple(r.m) for r in rows.select(D.month_title(rows.text).alias("m")).collect()]
    assert got == [(2, 2026), (10, 2026), (10, None), None, None, None]
    pairs = spark.createDataFrame([([(12, 2025), (1, 2026)],), ([(12, None), (1, None)],), ([(12, 2025), (1, 2025)],), ([(3, None), (5, None)],), ([],)], "m array<struct<month:int,year:int>>")
    assert [r.d for r in pairs.select(D.months_disagree(pairs.m).alias("d")).collect()] == [False, False, True, True, False]
