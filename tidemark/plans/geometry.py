"""Queries over rectangles: boxes are made from order lines, an order being a picture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as R
from ..sources.tables import table
from .registry import query

BOXES = """(SELECT l_orderkey AS image, l_linenumber::BIGINT AS id, l_tax AS confidence, (l_partkey % 300)::BIGINT AS x, (l_suppkey % 90)::BIGINT AS y, (20 + l_quantity * 4)::BIGINT AS w, (10 + l_partkey % 40)::BIGINT AS h FROM lineitem)"""


def boxes(spark, sf):
    n = lambda c: c.cast("long")
    box = F.struct(n(F.col("l_partkey") % 300).alias("x"), n(F.col("l_suppkey") % 90).alias("y"), n(20 + F.col("l_quantity") * 4).alias("w"), n(10 + F.col("l_partkey") % 40).alias("h"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), n(F.col("l_linenumber")).alias("id"), F.col("l_tax").alias("confidence"), box.alias("box"))


@query(f"""
WITH b AS {BOXES} SELECT a.image, a.id AS a, c.id AS b, (greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)))::BIGINT AS area
FROM b a JOIN b c ON a.image = c.image AND a.id < c.id WHERE least(a.x + a.w, c.x + c.w) > greatest(a.x, c.x) AND least(a.y + a.h, c.y + c.h) > greatest(a.y, c.y)""")
def box_overlaps(spark, sf):
    """Overlapping boxes of one picture with their shared area."""
    b = boxes(spark, sf)
    pairs = b.alias("a").join(b.alias("c"), (F.col("a.image") == F.col("c.image")) & (F.col("a.id") < F.col("c.id")))
    return pairs.select(F.col("a.image").alias("image"), F.col("a.id").alias("a"), F.col("c.id").alias("b"), R.overlap_area(F.col("a.box"), F.col("c.box")).alias("area")).where("area > 0")


@query(f"""
WITH b AS {BOXES}, p AS (SELECT image, id AS line, x + w / 2 AS cx, y + h / 2 AS cy FROM b)
SELECT p.image, p.line, arg_min(b.id, b.id)::BIGINT AS "window" FROM p JOIN b ON b.image = p.image AND cx >= b.x AND cx < b.x + b.w AND cy >= b.y AND cy < b.y + b.h GROUP BY 1, 2""")
def point_in_box(spark, sf):
    """The frontmost window that holds a line's centre."""
    b = boxes(spark, sf)
    points = b.select("image", F.col("id").alias("line"), (F.col("box.x") + F.col("box.w") / 2).alias("cx"), (F.col("box.y") + F.col("box.h") / 2).alias("cy"))
    return R.frontmost(points, b.select("image", F.col("id").alias("window"), F.col("id").alias("stack"), "box"))


@query(f"""
WITH b AS {BOXES}, m AS (SELECT image, list_sort(list(h))[(count(*) // 2 + 1)::INT] AS m FROM b GROUP BY 1),
n AS (SELECT b.*, (y - coalesce(lag(y) OVER (PARTITION BY b.image ORDER BY y, x, id), y) > m / 2)::INT AS new FROM b JOIN m ON m.image = b.image),
r AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY y, x, id ROWS UNBOUNDED PRECEDING) AS line FROM n)
SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY line, x, y, id)::BIGINT AS place FROM r""")
def reading_order(spark, sf):
    return R.reading_order(boxes(spark, sf))


@query(f"""
WITH b AS {BOXES}, g AS (SELECT *, greatest(24, floor(w * 0.15)) AS mx, greatest(24, floor(h * 0.15)) AS my FROM b)
SELECT image, id, greatest(0, x - mx)::BIGINT AS x, greatest(0, y - my)::BIGINT AS y, (least(400, x + w + mx) - greatest(0, x - mx))::BIGINT AS w, (least(120, y + h + my) - greatest(0, y - my))::BIGINT AS h FROM g""")
def evidence_regions(spark, sf):
    return boxes(spark, sf).select("image", "id", R.evidence_region(F.col("box"), 400, 120).alias("r")).select("image", "id", "r.*")


@query()
def box_suppression(spark, sf):
    """Non-maximum suppression within each picture."""
    return R.suppressed(boxes(spark, sf))


@query()
def occlusion_shares(spark, sf):
    """Visible share of each window."""
    return R.visible(boxes(spark, sf).select("image", F.col("id").alias("window"), F.col("id").alias("stack"), "box"))
