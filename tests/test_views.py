"""Calendar views, clocks and the applying of trials on small pictures made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import applying, clocks, grids, headers

LINE = "image int, n long, text string, x long, y long, w long, h long"


def month(image, start, cells, title=None, left=100, wide=90, noise=()):
    rows = [(image, k + 1, str((start + dt.timedelta(k)).day), left + k % 7 * wide, 200 + k // 7 * 80, 8 * len(str((start + dt.timedelta(k)).day)), 14) for k in cells]
    return rows + ([(image, 900, title, 300, 100, 120, 20)] if title else []) + [(image, 950 + k, *line) for k, line in enumerate(noise)]


def test_month_cells(spark):
    start, today = dt.date(2026, 9, 28), dt.date(2026, 10, 14)
    rows = month(1, start, range(35), "October 2026", noise=[("12", 1000, 30, 16, 14), ("13", 1000, 70, 16, 14), (None, 0, 0, 1, 1)])
    rows += month(2, start, [0, 1, 2, 3, 4, 7, 8, 9, 17, 25], "Octubre de 2026")  # most labels were missed
    rows += month(3, start, range(6)) + month(4, start, range(35)) + month(5, start, range(35), "October 2026", noise=[("1 abr", 100, 150, 40, 14)])
    pictures = spark.createDataFrame([(k, today) for k in range(1, 7)], "image int, today date")
    found = {r["image"]: r.cells for r in grids.month_cells(spark.createDataFrame(rows, LINE), pictures).collect()}
    assert sorted(found) == [1, 2, 4, 5]
    for image, cells in found.items():
        assert [c.day for c in cells] == [start + dt.timedelta(k) for k in range(28 if image == 2 else 35)]
        assert {c.assumed for c in cells} == {image == 4} and {c.conflict for c in cells} == {image == 5}
    assert [c.line for c in found[2]][:11] == [1, 2, 3, 4, 5, -6, -7, 8, 9, 10, -11]
    assert not grids.month_cells(spark.createDataFrame([], LINE), pictures).collect()


def test_nearest_cell_is_the_cheapest_of_all(spark):
    start = dt.date(2026, 9, 28)
    cells = grids.month_cells(spark.createDataFrame(month(1, start, range(35), "October 2026"), LINE), spark.createDataFrame([(1, start)], "image int, today date")).first().cells
    spots = [(float(x), float(y)) for x in range(80, 760, 37) for y in range(190, 640, 41)]
    df = spark.createDataFrame(spots, "x double, y double").crossJoin(spark.createDataFrame([(1, cells)], f"image int, cells {grids.CELL}"))
    for r in df.select("x", "y", grids.nearest_cell(F.col("cells"), F.col("x"), F.col("y")).alias("c")).collect():
        above = [c for c in cells if c.mid_y <= r.y]
        want = min(above, key=lambda c: (3 * abs(c.mid_x - c.width / 2 - r.x) + r.y - c.mid_y, c.day), default=None)
        assert (r.c and r.c.day) == (want and want.day)


def test_week_headers(spark):
    head = lambda image, n, text, x, y=60: (image, n, text, x, y, 8 * len(text or ""), 14)
    rows = [head(1, 1, "Mon 12", 100), head(1, 2, "Wed 14", 320), head(1, 3, "Fri 16", 540), head(1, 4, "9:00", 10), head(1, 5, None, 0)]
    rows += [head(2, k + 1, t, 100 + 110 * k) for k, t in enumerate(("Lun", "Mar", "Mié"))] + [head(2, k + 5, str(12 + k), 104 + 110 * k, 84) for k in range(3)] + [head(2, 9, "Octubre de 2026", 300, 10)]
    rows += [head(3, 1, "mar 13", 100), head(3, 2, "Wed 14 January", 210), head(3, 3, "October 2026", 300, 10)] + [head(4, 1, "Visit", 50)]
    today = dt.date(2026, 10, 20)
    pictures = spark.createDataFrame([(k, today) for k in range(1, 5)], "image int, today date")
    found = headers.week_headers(dates.parse(spark.createDataFrame(rows, LINE)), pictures)
    out = {k: sorted((r.mid_x, r.line, str(r.day), r.assumed, r.conflict) for r in found.collect() if r["image"] == k) for k in range(1, 5)}
    assert [(line, day, assumed) for _, line, day, assumed, _ in out[1]] == [(1, "2026-10-12", True), (0, "2026-10-13", True), (2, "2026-10-14", True), (0, "2026-10-15", True), (3, "2026-10-16", True)]
    assert [(line, day, assumed) for _, line, day, assumed, _ in out[2]] == [(5, "2026-10-12", False), (6, "2026-10-13", False), (7, "2026-10-14", False)]
    assert [c for *_, c in out[3]] == [True, True] and out[3][0][2] == "2026-10-13" and out[4] == []
    lines = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate((0, 130, 236, 240, 900))] + [(4, 9, 1.0)], "image int, n long, mx double")
    got = {(r["image"], r.n): str(r.day) for r in headers.nearest_header(lines, found).collect()}
    heads = {k: [(x, line, day) for x, line, day, *_ in v] for k, v in out.items()}
    for image, n, x in [(r["image"], r.n, r.mx) for r in lines.collect()]:
        assert got[image, n] == (min(heads[image], key=lambda h: (abs(h[0] - x), h[0]))[2] if heads[image] else "None")


@pytest.mark.parametrize(("text", "at", "source", "guess"), [
    ("Wed 14 Oct 10:31", "2026-10-14 10:31:00", "screen-clock", False), ("9:41", "2026-10-14 09:41:00", "screen-clock", False), ("Wed 14 10:15", "2026-10-14 10:15:00", "screen-clock", False),
    ("Thu 14 10:15", "2026-10-14 12:00:00", "capture", True), ("1 Dec 10:00", "2026-10-14 12:00:00", "capture-far-clock", True), ("Files", "2026-10-14 12:00:00", "capture", True),
])
def test_screen_clocks(spark, text, at, source, guess):
    line = "shot int, window int, text string, x int, y int, w int, h int"
    lines = dates.parse(spark.createDataFrame([(1, None, text, 900, 5, 80, 14), (1, 1, "3:00", 5, 300, 30, 12), (1, None, None, 0, 0, 1, 1)], line))
    windows = spark.sql("SELECT 1 AS shot, 1 AS window, true AS remote, 100 AS y, 400 AS h, timestamp_ntz'2026-10-14 12:00:00' AS captured, 1000 AS picture_height, true AS per_window, false AS window_only")
    (row,) = clocks.reference_clocks(lines, windows).collect()
    assert (str(row.instant), row.source, row.guess) == (at, source, guess)


def test_replaced_sightings(spark):
    plan = spark.createDataFrame([(1, 1, "a", "Stand up", "existing", "7"), (1, 2, "b", "stand-up!", "existing", "7"), (1, 3, "c", "Other", "same", "2"), (1, 4, "d", "Lone", "existing", "9"), (1, 5, "e", "New", "new", None)], "image int, step int, finding string, title string, target string, other string")
    items = spark.createDataFrame([(7, None), (8, 7)], "item int, merged_into int")
    sightings = spark.createDataFrame([(1, 7, "s1", "stand up", 1), (1, 7, "s2", "Stand up", 2), (1, 7, "s3", "Review", 3), (2, 7, "s4", "Stand up", 1)], "image int, item int, sighting string, title string, created int")
    chosen = spark.createDataFrame([("a",), ("c",), ("d",), ("e",), ("zz",)], "finding string")
    made, told = applying.apply_selected(plan, chosen, items)
    assert {r.finding: r.outcome for r in told.collect()} == {"a": "applied", "c": "applied", "d": "item gone", "e": "applied", "zz": "no longer applies"}
    assert {(r.finding, r["item"]) for r in made.collect()} == {("a", "7"), ("b", "7"), ("c", "7"), ("e", "new:e")}
    assert {(r.finding, r.sighting) for r in applying.replaced_sightings(plan, made, sightings, items).collect()} == {("a", "s2"), ("b", "s1"), ("c", "s3")}


def test_lines_of_the_subject(spark):
    heads = spark.createDataFrame([(1, 100.0, 60.0), (1, 210.0, 62.0), (1, 320.0, 60.0), (2, 100.0, 60.0)], "image int, mid_x double, mid_y double")
    spots = [(1, 1, 100, 300), (1, 2, 20, 300), (1, 3, 380, 300), (1, 4, 400, 300), (1, 5, 200, 30), (1, 6, 210, 500), (2, 7, 9999, 5), (3, 8, 0, 0)]
    lines = spark.createDataFrame([(image, n, "t", x, y, 0, 0) for image, n, x, y in spots], LINE)
    frame = "image int, window int, stack int, x int, y int, w int, h int"
    seen = lambda windows: sorted(r.n for r in grids.subject_lines(lines, grids.week_regions(heads), spark.createDataFrame(windows, frame)).collect())
    assert seen([]) == [1, 3, 6, 7, 8]
    assert seen([(1, 1, 2, 0, 0, 900, 900), (1, 2, 1, 150, 450, 200, 100), (1, 3, 3, 50, 250, 100, 100)]) == [1, 3, 7, 8]
    assert seen([(1, 1, 2, 0, 0, 900, 900), (1, 2, None, 150, 450, 200, 100)]) == [1, 3, 6, 7, 8]
