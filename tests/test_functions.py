import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text, times
from tidemark.operators import linkage, reconcile


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("  Café — Réunion… ", "cafe reunion"), ("Bob's  1:1.", "bobs 1 1"), ("…", ""), ("", ""), ("Straße & Œuvre", "straße œuvre"), (None, None)])
def test_normalise(spark, raw, want):
    assert value(spark, text.normalise(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("a, b, want", [("", "x", 0.0), ("team sync", "team sync", 1.0), ("design review", "design review with ana", 0.95), ("abc", "abd", 2 / 3), ("lunch ana", "ana lunch", 1.0)])
def test_title_similarity(spark, a, b, want):
    assert abs(value(spark, text.title_similarity(F.lit(a), F.lit(b))) - want) < 1e-9
    assert abs(reconcile.similarity(a, b) - want) < 1e-9


@pytest.mark.parametrize("a, b, want", [("ab", "abcdef", 1 / 3), ("abc", "abcdef", 0.8 + 0.1 * 0.99), ("", "", 0.0), ("x1", "x1", 1.0)])
def test_evaluation_similarity(spark, a, b, want):
    assert abs(value(spark, text.evaluation_similarity(F.lit(a), F.lit(b))) - want) < 1e-9


@pytest.mark.parametrize(
    "said, want",
    [
        ("Wed 14", {"weekday": 3, "day": 14}), ("14 de octubre de 2026", {"day": 14, "month": 10, "year": 2026}), ("Oct 14, 2026", {"day": 14, "month": 10, "year": 2026}),
        ("2026-03-09 15:30", {"year": 2026, "month": 3, "day": 9, "hour": 15, "minute": 30}), ("3/4", {"day": 3, "month": 4, "order_assumed": True}), ("25/4/26", {"day": 25, "month": 4, "year": 2026}),
        ("próximo lunes", {"rel": "next", "rel_n": 1}), ("el martes que viene", {"rel": "next", "rel_n": 2}), ("end of the week", {"rel": "end"}), ("en 3 días", {"rel": "days", "rel_n": 3}),
        ("mañana a las 9:00", {"rel": "tomorrow", "hour": 9, "minute": 0}), ("por la mañana", None), ("12 am", {"hour": 0, "minute": 0}), ("3:15 pm", {"hour": 15, "minute": 15}), ("15h30", {"hour": 15, "minute": 30}),
        ("25:00", None), ("", None), (None, None), ("nothing here", None),
    ],
)
def test_parse_dates(said, want):
    found = dates.parse_text(said)
    assert found == (want and {"order_assumed": False, **want})


def test_parse_and_resolve_rows(spark):
    rows = spark.createDataFrame([(1, "today"), (2, None), (3, "5 enero"), (4, "friday"), (5, "zzz")], "id int, text string")
    got = {r.id: r.d for r in dates.parse(rows).select("id", dates.resolve(F.col("parsed"), F.lit("2024-12-18").cast("date")).cast("string").alias("d")).collect()}
    assert got == {1: "2024-12-18", 2: None, 3: "2025-01-05", 4: "2024-12-20", 5: None}
    assert dates.custom_range("2024-02-01", "2024-01-01") == ("2024-01-01 00:00:00", "2024-02-01 23:59:59")


def test_time_agreement(spark):
    m = times.MINUTE

    def score(a, b, ad=False, bd=False, day=True):
        lit = lambda v: F.lit(v).cast("long")
        return value(spark, times.event_agreement(lit(a[0]), lit(a[1]), F.lit(ad), lit(b[0]), lit(b[1]), F.lit(bd), F.lit(day)))

    assert score((0, None), (0, None)) == 1.0
    assert score((0, 60 * m), (30 * m, None)) == 0.8
    assert score((0, None), (15 * m, None)) == 0.6
    assert score((0, None), (16 * m, None)) == 0.0
    assert score((0, None), (5 * m, None), ad=True) == 0.5
    assert score((None, None), (None, None)) == 1.0
    assert score((None, None), (0, None)) == 0.0
    assert score((0, None), (0, None), day=False) == 0.0


def test_decide(spark):
    d = lambda t, m, c, u: value(spark, linkage.decide(F.lit(t), F.lit(m), F.lit(c).cast("double"), F.lit(u)))
    assert d(0.95, 0.6, None, False) == "merge:text-time"
    assert d(0.3, 0.6, None, False) == "new:different"
    assert d(0.3, 0.9, None, False) == "uncertain:"
    assert d(0.3, 0.6, 0.9, False) == "uncertain:"
    assert d(0.9, 0.0, None, True) == "merge:undated-text"
    assert d(0.6, 0.0, None, True) == "new:undated-low-text"
