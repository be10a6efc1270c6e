"""Evaluation: one-to-one matching and the quality of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evaluation_similarity
from ..sources.folders import settled


def merge_quality(rows: DataFrame) -> DataFrame:
    """recall, wrong, items of (event, item) rows. Pairs are counted from group sizes, never made."""
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    together = rows.groupBy("event", "item").agg(F.count("*").alias("n"))
    wanted = together.groupBy("event").agg(F.sum("n").alias("n"))
    a, b = together.agg(pairs.alias("together")), wanted.agg(pairs.alias("wanted"))
    w = together.groupBy("item").agg(F.count("*").alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("wrong"), F.count("*").alias("items"))
    one = a.join(b).join(w)
    return one.select(F.round(F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("together") / F.col("wanted")), 6).alias("recall"), "wrong", "items")


def greedy_match(want: DataFrame, got: DataFrame, least: float, most_gap: int) -> DataFrame:
    """(case, want, got, score): pairs taken from the best down, each side once.

    Rows are (case, id, title, at). Best means similarity, then gap, then ids. In each round the pairs that are the
    best of both their sides are taken and their sides removed; what is left goes to the next round. The best pair
    left is always taken, so the outcome is that of one sorted walk, without a case in one task. Sides meet by bins of
    their times, never by the case alone.
    """
    score, gap = evaluation_similarity(F.col("a.title"), F.col("b.title")), F.abs(F.col("a.at") - F.col("b.at"))
    width = max(1, most_gap)
    near = F.explode(F.sequence(F.floor((F.col("at") - most_gap) / width), F.floor((F.col("at") + most_gap) / width)))
    a, b = want.withColumn("_bin", near).alias("a"), got.withColumn("_bin", F.floor(F.col("at") / width)).alias("b")
    left = a.join(b, (F.col("a.case") == F.col("b.case")) & (F.col("a._bin") == F.col("b._bin"))).select(F.col("a.case").alias("case"), F.col("a.id").alias("want"), F.col("b.id").alias("got"), score.alias("score"), gap.alias("gap"))
    left = settled(left.where((F.col("score") >= least) & (F.col("gap") <= most_gap)))  # titles are compared once, not in every round
    order = [F.col("score").desc(), "gap", "want", "got"]
    taken = None
    while True:
        ranked = left.withColumn("i", F.row_number().over(Window.partitionBy("case", "want").orderBy(*order))).withColumn("j", F.row_number().over(Window.partitionBy("case", "got").orderBy(*order)))
        best = settled(ranked.where("i = 1 AND j = 1").select("case", "want", "got", F.round("score", 6).alias("score")))
        if best.isEmpty():
            return best if taken is None else taken
        taken = best if taken is None else taken.unionByName(best)
        left = settled(left.join(best.select("case", "want"), ["case", "want"], "left_anti").join(best.select("case", "got"), ["case", "got"], "left_anti"))
