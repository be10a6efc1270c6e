"""Steps that join one another: a picture's closure in one pass, whatever the length of its chains or the cut of its batches."""

import pytest

from tidemark.operators import applying

PLAN = "image string, step int, finding string, title string, target string, other string"


@pytest.mark.parametrize("batch", ["10000", "3", "1"])
def test_chains_of_steps(spark, batch):
    rows = [("p", k, f"p{k}", "t", "same" if k else "new", str(k - 1)) for k in range(40)]
    rows += [("q", 2, "q2", "t", "existing", "9"), ("q", 5, "q5", "t", "same", "2"), ("q", 6, "q6", "t", "same", "4"), ("q", 7, "q7", "t", "possible", "7"), ("q", 8, "q8", "t", "same", "5")]
    rows += [("r", 1, "r1", "t", "same", "2"), ("r", 2, "r2", "t", "same", "1"), ("r", 3, "r3", "t", "existing", "8"), ("s", 1, "s1", "t", "new", None), (None, 1, "z1", "t", "new", None)]
    items = spark.createDataFrame([(7, None), (8, 7)], "item int, merged_into int")
    chosen = spark.createDataFrame([(f,) for f in ("p37", "q6", "q7", "q8", "r1", "r3", "z1", "none", "q7")], "finding string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made, told = applying.apply_selected(spark.createDataFrame(rows, PLAN), chosen, items)
        got = {r.finding: (r["item"], r.joined, r.beside) for r in made.collect()}
        outcome = {r.finding: r.outcome for r in told.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {f"p{k}": ("new:p0", k > 0, None) for k in range(38)}
    assert got == want | {"q7": ("new:q7", False, "7"), "r3": ("7", True, None)}
    applied, not_applied = dict.fromkeys(("p37", "q7", "r3"), "applied"), dict.fromkeys(("q6", "q8", "r1", "z1", "none"), "no longer applies")
    assert outcome == applied | not_applied


def test_the_plan_is_computed_once_for_all_rounds(spark, monkeypatch):
    """However long a chain, one table is kept: a step was looked for in the whole plan again for each link of a chain."""
    kept = []
    settled = applying.settled
    monkeypatch.setattr(applying, "settled", lambda df: kept.append(1) or settled(df))
    rows = [("p", k, f"p{k}", "t", "same" if k else "new", str(k - 1)) for k in range(6)]
    items = spark.createDataFrame([(7, None)], "item int, merged_into int")
    made, _ = applying.apply_selected(spark.createDataFrame(rows, PLAN), spark.createDataFrame([("p5",)], "finding string"), items)
    assert made.count() == 6 and len(kept) == 1
