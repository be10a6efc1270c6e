"""Nearest vectors: the same rows as a plain comparison of all pairs, from parts of bounded size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import linkage

NAN, INF = float("nan"), float("inf")


def plain(known, asked, most):
    pairs = known.join(asked.withColumnRenamed("v", "q"), "label").where("a <> b")
    scored = pairs.select("a", "b", F.round(linkage.cosine(F.col("q"), F.col("v")), 5).alias("cosine"))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))).where(F.col("r") <= most).drop("r")


def told(rows):
    return sorted(map(str, rows.select("a", "b", "cosine").collect()))


@pytest.mark.parametrize("parts", [(4096, 1024), (7, 3)])
def test_nearest_is_the_plain_comparison(spark, monkeypatch, parts):
    monkeypatch.setattr(linkage, "KNOWN", parts[0])
    monkeypatch.setattr(linkage, "ASKED", parts[1])
    rng = random.Random(5)
    odd = [None, [], [0.0] * 4, [NAN, 1.0, 0.0, 0.0], [INF, 1.0, 2.0, 3.0], [1.0, 2.0], [1.0, None, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0]]
    rows = [(k, k % 3 if k % 17 else None, rng.choice(odd) if k % 6 == 0 else [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(120)]
    rows += [(500 + k, 1, [0.25, 0.5, 0.25, 0.0]) for k in range(40)] + [(None, 1, [1.0, 1.0, 1.0, 1.0]), (900, 7, [1.0, 1.0, 1.0, 1.0]), (3, 0, [1.0, 2.0, 3.0, 4.0])]
    known = spark.createDataFrame(rows, "b long, label int, v array<float>")
    asked = known.where("b % 5 = 0 OR b >= 900").withColumnRenamed("b", "a")
    want = told(plain(known, asked, 2))
    assert any("None" in x for x in want) and any("nan" in x for x in want)
    assert told(linkage.nearest(known, asked, "label", 2)) == want


def test_no_pair_is_a_row_between_tasks(spark):
    """Vectors meet as matrices: what leaves the comparison is a few rows for each one asked about, not one for each pair."""
    known = spark.createDataFrame([(k, 1, [1.0, float(k)]) for k in range(20)], "b long, label int, v array<float>")
    found = linkage.nearest(known, known.where("b % 10 = 0").withColumnRenamed("b", "a"), "label", 2)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString() and found.count() == 4
