"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_by_size, settled


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex of the (a, b) links other than itself.

    Each round hooks every vertex's larger neighbours, then its smaller ones, to its smallest neighbour; the table
    never gets longer than the links and a round is a few shuffles; a vertex with very many neighbours makes a skewed
    sort-merge join, which adaptive execution splits. It ends when a round changes nothing.
    """
    stars = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = state
        with dealt_by_size(links.sparkSession, state[0]) as parts:
            stars = stars.coalesce(parts)
            both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            stars = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
