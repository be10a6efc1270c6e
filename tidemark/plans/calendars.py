"""Queries over calendar views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..sources.tables import table
from .registry import query

LABELS = """(SELECT l_orderkey AS image, l_linenumber::BIGINT * 40 + (l_orderkey % 5 = 0)::INT * (l_partkey % 50) AS y,
 CASE WHEN l_orderkey % 2 = 0 THEN (7 + l_linenumber) || ':00' ELSE ((9 + l_linenumber) % 12 + 1) || CASE WHEN l_orderkey % 4 = 1 THEN '' WHEN 9 + l_linenumber >= 11 AND 9 + l_linenumber < 23 THEN ' PM' ELSE ' AM' END END AS text,
 CASE WHEN l_orderkey % 2 = 0 THEN 7 + l_linenumber WHEN l_orderkey % 4 = 1 THEN (9 + l_linenumber) % 12 + 1 ELSE 10 + l_linenumber END AS hour FROM lineitem)"""


def _labels(spark, sf):
    n, o = F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    y = n * 40 + F.when(o % 5 == 0, F.col("l_partkey") % 50).otherwise(0)
    half = F.when(o % 4 == 1, "").when((9 + n >= 11) & (9 + n < 23), " PM").otherwise(" AM")
    said = F.when(o % 2 == 0, F.concat((7 + n).cast("string"), F.lit(":00"))).otherwise(F.concat(((9 + n) % 12 + 1).cast("string"), half))
    return table(spark, sf, "lineitem").select(o.alias("image"), y.alias("y"), said.alias("text"))


@query(f"""
WITH l AS (SELECT image, y, hour, (hour < coalesce(lag(hour) OVER w, hour))::INT AS back FROM (SELECT image, y, arg_min(hour, text) AS hour FROM {LABELS} GROUP BY 1, 2) WINDOW w AS (PARTITION BY image ORDER BY y)),
u AS (SELECT image, y, hour + 12 * sum(back) OVER (PARTITION BY image ORDER BY y ROWS UNBOUNDED PRECEDING) AS hour FROM l),
s AS (SELECT image, hour, (y - lag(y) OVER w) / nullif(hour - lag(hour) OVER w, 0)::DOUBLE AS step FROM u WINDOW w AS (PARTITION BY image ORDER BY y))
SELECT image, min(hour)::BIGINT AS first_hour, max(hour)::BIGINT AS last_hour, count(*)::BIGINT AS labels FROM s GROUP BY image
HAVING count(*) >= 3 AND min(step) > 0 AND max(step) <= 1.2::DOUBLE * min(step) AND max(hour) - min(hour) >= 2 AND max(hour) <= 24""")
def hour_scales(spark, sf):
    """Pictures whose clock labels make an even scale, with its first and last hour."""
    found = C.hour_scales(_labels(spark, sf).groupBy("image", "y").agg(F.min("text").alias("text")))
    return found.select("image", F.col("first_hour").cast("long").alias("first_hour"), F.col("last_hour").cast("long").alias("last_hour"), "labels")


@query("""
SELECT o_orderkey, strftime(o_orderdate::DATE - CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END::INT, '%Y-%m-%d') || ' 09:00' AS remind FROM orders""")
def deadline_reminders(spark, sf):
    """Nine o'clock on the working day before a deadline."""
    day = C.working_day_before(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat(day.cast("string"), F.lit(" 09:00")).alias("remind"))


@query("""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%d/%m/%Y') ELSE '2024-13-01' END AS x, ts FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE 'invalid' END AS edited FROM t""")
def strict_edits(spark, sf):
    """Typed times in the two accepted forms, anything else refused."""
    e, ts = F.col("event_id"), F.col("ts").cast("string")
    said = F.when(e % 4 == 0, F.substring(ts, 1, 16)).when(e % 4 == 1, F.substring(ts, 1, 10)).when(e % 4 == 2, "01/02/2024").otherwise("2024-13-01")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.substring(C.strict_edit(said).cast("string"), 1, 19), F.lit("invalid")).alias("edited"))


@query("""
WITH d AS (SELECT d::DATE AS d FROM range(DATE '2023-01-01', DATE '2025-01-01', INTERVAL 1 DAY) t(d)),
k AS (SELECT d, isodow(d) AS w, day(d) AS n FROM d), e AS (SELECT event_id, ts::DATE AS today, (1 + event_id % 7)::INT AS w, (1 + event_id % 31)::INT AS n FROM events)
SELECT event_id, coalesce(min_by(d, (abs(d - today), d))::VARCHAR, 'none') AS day FROM e LEFT JOIN k ON k.w = e.w AND k.n = e.n AND abs(d - today) <= 183 GROUP BY event_id""")
def nearest_days(spark, sf):
    """A weekday and a day number as the nearest such day."""
    e = F.col("event_id")
    found = C.nearest_day(F.col("ts").cast("date"), 1 + e % 7, 1 + e % 31)
    return table(spark, sf, "events").select("event_id", F.coalesce(found.cast("string"), F.lit("none")).alias("day"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%a %-d %b') || CASE WHEN o_orderkey % 3 = 0 THEN ', all day' ELSE strftime(o_orderdate, ' %H:%M') END AS said FROM orders""")
def date_texts(spark, sf):
    """How the list writes an item's time."""
    day = F.date_format("o_orderdate", "EEE d MMM")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(day, F.when(F.col("o_orderkey") % 3 == 0, ", all day").otherwise(F.date_format("o_orderdate", " HH:mm"))).alias("said"))
