from pyspark.sql import functions as F

from tidemark.operators import evaluation, linkage, reconcile, resolve, search, spatial, trials
from tidemark.plans import relational
from tidemark.sources import cases
from tidemark.streaming import notices


def test_query_parsing():
    t = search.parse('Café "big plan" -"old one" -x sta')
    assert t == search.Terms(("cafe", "sta"), (("big", "plan"),), (("old", "one"), ("x",)), True)
    assert not search.parse("a").searchable and search.parse("ab").searchable
    assert search.parse('x "open phrase').phrases == (("open", "phrase"),)
    assert not search.parse('sta "x y"').prefix_last


def test_search(spark):
    docs = spark.createDataFrame([(1, "Big plan for Café", ""), (2, "plan big", "cafeteria"), (3, None, None)], "id int, title string, notes string")
    hits = lambda typed: {r.doc for r in search.ranked(docs, "id", {"title": ("title", 10.0), "notes": ("notes", 2.0)}, search.parse(typed)).collect()}
    assert hits("caf") == {1, 2} and hits('"big plan"') == {1} and hits("plan -cafe") == {2} and hits("zzz") == set()


def test_sequential_assignment(spark):
    rows = [(1, 0, 1, 10, "team sync", 0, False), (1, 0, 2, 11, "team sync", 600_000_000, False), (1, 0, 3, 12, "other", 0, False), (2, 0, 1, 13, "team sync", 0, False), (1, 0, 4, 14, "team sync with ana", 0, False)]
    df = spark.createDataFrame(rows, "context int, at long, seq int, finding long, title string, start long, all_day boolean")
    got = {r.finding: r.item for r in linkage.assign(df, ["context"]).collect()}
    assert got == {10: 10, 11: 10, 12: 12, 13: 13, 14: 14} | {14: 10 if reconcile.similarity("team sync", "team sync with ana") >= 0.9 else 14}


def test_pairwise_resolution(spark):
    rows = [
        (1, "title", "Plan", "read", 0.9, 1, 1), (1, "title", "Plan with Ana", "read", 0.5, 0, 1), (1, "place", "x", "read", 0.9, 1, 1), (1, "place", "y", "inferred", 1.0, 2, 1),
        (2, "title", "A", "read", 0.5, 3, 1), (2, "title", "B", "read", 0.62, 2, 1), (3, "title", "mine", "user", 1.0, 0, 1), (3, "title", "theirs", "read", 1.0, 9, 1), (4, "title", None, "read", 1.0, 9, 1),
    ]
    df = spark.createDataFrame(rows, "item long, field string, value string, source string, confidence double, at long, seq int")
    got = {(r.item, r.field): r.value for r in resolve.resolve_pairwise(df).collect()}
    assert got == {(1, "title"): "Plan with Ana", (1, "place"): "x", (2, "title"): "B", (3, "title"): "mine"}


def test_tied_observations(spark):
    rows = [(k, "place", f"room {v}", "read", 0.9, 5, 1) for k in range(20) for v in (3, 1, 2)] + [(k, "place", "room 4", "read", 0.9, 5, 0) for k in range(20)]
    kind = "item long, field string, value string, source string, confidence double, at long, seq int"
    for stored in (rows, rows[::-1], sorted(rows, key=lambda r: r[2])):
        got = [(r.item, r.value) for r in resolve.resolve_fields(spark.createDataFrame(stored, kind)).collect()]
        assert sorted(got) == [(k, "room 3") for k in range(20)]


def test_tied_windows(spark):
    rows = [(k, 1, 1, 200, 100, (x, 5, 10, 10)) for k in range(20) for x in (40, 20, 30, 10)] + [(k, 1, 0, 200, 100, (90, 5, 10, 10)) for k in range(20)]
    kind = "image long, window long, stack int, width int, height int, box struct<x: int, y: int, w: int, h: int>"
    for stored in (rows, rows[::-1], sorted(rows, key=lambda r: r[5])):
        got = [(r.image, r.box.x) for r in spatial.selected_windows(spark.createDataFrame(stored, kind), 3).collect()]
        assert sorted(got) == [(k, x) for k in range(20) for x in (10, 20, 90)]


def test_rectangles():
    assert sum(w * h for _, _, w, h in spatial.cut((0, 0, 10, 10), (2, 2, 3, 3))) == 91
    assert spatial.cut((0, 0, 4, 4), (9, 9, 2, 2)) == [(0, 0, 4, 4)]
    assert spatial.cut((0, 0, 4, 4), (0, 0, 9, 9)) == []


def test_visible_and_suppressed(spark):
    box = "box struct<x:long,y:long,w:long,h:long>"
    windows = spark.createDataFrame([(1, 0, 1, (0, 0, 5, 10)), (1, 1, 2, (0, 0, 10, 10)), (2, 0, 3, (0, 0, 1, 1))], f"image long, stack int, window long, {box}")
    assert {(r.image, r.window): r.share for r in spatial.visible(windows).collect()} == {(1, 1): 1.0, (1, 2): 0.5, (2, 3): 1.0}
    boxes = spark.createDataFrame([(1, 1, 0.9, (0, 0, 10, 10)), (1, 2, 0.5, (1, 1, 10, 10)), (1, 3, 0.5, (50, 0, 4, 4))], f"image long, id long, confidence double, {box}")
    assert {r.id for r in spatial.suppressed(boxes).collect()} == {1, 3}


def test_greedy_match(spark):
    kind = "case int, id long, title string, at long"
    want = spark.createDataFrame([(1, 1, "abcd", 0), (1, 2, "abcx", 0)], kind)
    got = spark.createDataFrame([(1, 5, "abcd", 0), (1, 6, "abcd", 1)], kind)
    assert {(r.want, r.got) for r in evaluation.greedy_match(want, got, 0.5, 5).collect()} == {(1, 5), (2, 6)}


def test_merge_quality_of_nothing(spark):
    row = evaluation.merge_quality(spark.createDataFrame([], "event int, item int")).first()
    assert row.items == 0 and row.wrong == 0


def test_pointers(spark):
    df = spark.createDataFrame([(k, k - 1 if k > 1 else None) for k in range(1, 15)], "id long, target long")
    got = {r.id: r["at"] for r in relational.live(df).collect()}
    assert got == {k: max(1, k - 10) for k in range(1, 15)}


def test_spans(spark):
    points = spark.createDataFrame([(1, 0, 5), (2, 0, 10), (3, 0, 11), (4, 1, 5)], "id int, grp int, at long")
    spans = spark.createDataFrame([(0, 5, 10)], "grp int, start long, stop long")
    assert {r.id for r in relational.in_spans(points, spans, 3).collect()} == {1, 2}


def test_diff_of_nothing(spark):
    kind = "item int, a string"
    a, b = spark.createDataFrame([(1, None), (2, "x")], kind), spark.createDataFrame([(1, None), (2, "y"), (3, "z")], kind)
    assert {(r.item, r.state, r.fields) for r in trials.diff(a, b, "item", ["a"]).collect()} == {(1, "unchanged", ""), (2, "changed", "a"), (3, "new", "")}


def test_notices():
    assert notices.notices([0, 10, 25, 100], 20, 40) == [(0, 40, 3), (100, 120, 1)]
    assert notices.accept([0, 100, 299, 300, 500, 650], None, 300)[0] == [True, False, False, True, False, True]


def test_notice_windows(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 10, 25, 100)] + [(2, 5)], "k long, t long")
    assert {tuple(r) for r in notices.notice_windows(df, "k", "t", 20, 40).collect()} == {(1, 0, 40, 3), (1, 100, 120, 1), (2, 5, 25, 1)}


def test_debounced_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 100), (1, 400), (2, 7)], "k long, t long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, t long").parquet(f"{tmp_path}/in")
    out = notices.run_to_end(notices.debounced_stream(stream, "k", 300), str(tmp_path), "append")
    assert {(r.k, r.t) for r in out.collect()} == {(1, 0), (1, 400), (2, 7)}


def test_sequence_source(spark, tmp_path):
    folder = tmp_path / "a" / "case1"
    folder.mkdir(parents=True)
    (folder / "sequence.json").write_text(
        '{"macTimezone":"UTC","contexts":[{"id":"w","name":"Work"}],"captures":[{"id":"c1","capturedAt":"2026-01-01T10:00:00Z","context":"w","findings":[{"event":"e","kind":"task","title":"T"}]},'
        '{"id":"c2","capturedAt":"2026-01-01T11:00:00Z","context":"x","findings":[{"event":"e","kind":"task","title":" "}]}]}'
    )
    read = cases.sequences(spark, str(tmp_path))
    assert [(r.case, r.capture, r.title) for r in cases.sequence_findings(read).orderBy("capture").collect()] == [("case1", "c1", "T"), ("case1", "c2", " ")]
    assert {r.problem for r in cases.sequence_problems(read).collect()} == {"missing title", "unknown context"}


def test_snapshot(spark, tmp_path):
    df = spark.range(5)
    made = cases.snapshot({"x": df, "y": df.where("id > 9")}, str(tmp_path / "s"))
    assert {(r.name, r.rows) for r in made.collect()} == {("x", 5), ("y", 0)}
    assert {r.id for r in cases.replace_keys(df, spark.range(3, 8), "id").collect()} == set(range(8))


def test_log_lines_are_the_same_at_every_number_of_strings(spark):
    from tidemark.operators.reading import loggable

    lines = spark.createDataFrame([(k, t) for k, t in enumerate(["plan x now", "quiet", "", "a", "the Theme", "see \\E marks", "it", "NAMES here", "x"])], "k int, t string")
    for strings in (["x"], ["theme", "it"], ["\\e", "names"], ["a", "qui", "zz"], ["", "plan x"]):
        bad = spark.createDataFrame([(s,) for s in strings], "s string")
        left = lambda most: sorted(r.k for r in loggable(lines, "t", bad, "s", most=most).collect())  # noqa: B023, E731
        want = [k for k, t in ((r.k, r.t.lower()) for r in lines.collect()) if not any(s and s in t for s in strings)]
        assert left(1_000) == left(0) == want


def test_chains_of_merges_end_after_ten_items(spark):
    from tidemark.operators import actions

    rows = [(k, k - 1 if k else None) for k in range(14)] + [(50, 51), (51, 50), (60, 61), (70, 70)]
    live = {r["item"]: r.live for r in actions.survivors(spark.createDataFrame(rows, "item long, merged_into long")).collect()}
    assert live == {k: 0 if k < 10 else None for k in range(14)} | {50: None, 51: None, 60: None, 70: None}


def test_outcomes_of_jobs(spark):
    from tidemark.operators import jobs

    table = spark.createDataFrame([(1, "running", 5, 0), (2, "running", 5, 1), (3, "running", 5, 2), (4, "running", 5, 1), (5, "running", 5, 2), (6, "waiting", 5, 0)], "job int, state string, not_before long, attempts int")
    told = spark.createDataFrame([(1, "transient", 100), (2, "transient", 100), (3, "transient", 100), (4, "permanent", 100), (5, "unavailable", 100), (6, "success", 100)], "job int, outcome string, at long")
    out = {r.job: (r.state, r.not_before, r.attempts) for r in jobs.after_run(table, told).collect()}
    assert out == {1: ("waiting", 110, 1), 2: ("waiting", 160, 2), 3: ("failed", 5, 3), 4: ("failed", 5, 1), 5: ("waiting", None, 2), 6: ("waiting", 5, 0)}
