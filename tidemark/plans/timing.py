"""Queries over times, days and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.times import DAY, MINUTE, day_key, event_agreement, micros, moment, todo_agreement
from ..sources.tables import table
from .registry import query


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s, CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) + (event_id % 3) * 1800000000 END AS t, event_type = 'signup' AS d, ts::DATE AS day FROM events),
p AS (SELECT a.event_id AS a, b.event_id AS b, a.s AS x, b.s AS y, greatest(coalesce(a.t, a.s), a.s) AS xe, greatest(coalesce(b.t, b.s), b.s) AS ye, a.d AS ad, b.d AS bd
  FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id)
SELECT a, b, score FROM (SELECT a, b, CASE WHEN ad AND bd THEN 1.0 WHEN ad OR bd THEN 0.5 WHEN abs(x - y) < 1000000 THEN 1.0 WHEN x < ye AND y < xe THEN 0.8 WHEN abs(x - y) <= 900000000 THEN 0.6 ELSE 0.0 END::DOUBLE AS score FROM p) WHERE score > 0""")
def time_agreement_pairs(spark, sf):
    """Pairs of a user's events on one day whose times agree at all."""
    at = micros(F.col("ts"))
    e = table(spark, sf, "events").select("event_id", "user_id", at.alias("s"), F.when(F.col("event_id") % 4 > 0, at + (F.col("event_id") % 3) * 30 * MINUTE).alias("t"), (F.col("event_type") == "signup").alias("d"), F.floor(at / DAY).alias("day"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.event_id") < F.col("b.event_id")))
    score = event_agreement(F.col("a.s"), F.col("a.t"), F.col("a.d"), F.col("b.s"), F.col("b.t"), F.col("b.d"), F.lit(True))
    return pairs.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), score.alias("score")).where("score > 0")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS u, o_orderdate::DATE AS day FROM orders)
SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN abs(a.u - b.u) < 1000000 THEN 1.0 WHEN a.day = b.day THEN 0.8 ELSE 0.6 END::DOUBLE AS score
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.u - b.u) <= 86400000000""")
def todo_agreement_pairs(spark, sf):
    """To-dos within a day: each row meets the days before, of and after its own."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("u")).withColumn("day", F.floor(F.col("u") / DAY))
    near = o.withColumn("key", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)))
    a, b = near.alias("a"), o.alias("b")
    pairs = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.key") == F.col("b.day")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    score = todo_agreement(F.col("a.u"), F.col("b.u"), F.col("a.day") == F.col("b.day"))
    return pairs.select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), score.alias("score")).where("score > 0")


@query("""
WITH z(zone, off) AS (VALUES ('UTC', 0), ('plus530', 330), ('minus8', -480))
SELECT event_id, zone, strftime(ts + to_minutes(off), '%Y-%m-%d') AS day FROM events, z""")
def day_key_multi_zone(spark, sf):
    """The local day of each event in three zones."""
    zones = F.array(*[F.struct(F.lit(n).alias("zone"), F.lit(o).alias("off")) for n, o in (("UTC", 0), ("plus530", 330), ("minus8", -480))])
    rows = table(spark, sf, "events").select("event_id", micros(F.col("ts")).alias("u"), F.explode(zones).alias("z"))
    return rows.select("event_id", "z.zone", day_key(F.col("u"), F.col("z.off")).alias("day"))


@query("""
WITH p(preset, lo, hi) AS (VALUES ('today', TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-17 23:59:59'), ('last7', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-17 23:59:59'),
('last30', TIMESTAMP '2023-12-19', TIMESTAMP '2024-01-17 23:59:59'), ('month', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:59:59'), ('next30', TIMESTAMP '2024-01-17', TIMESTAMP '2024-02-15 23:59:59'))
SELECT preset, count(event_id)::BIGINT AS n FROM p LEFT JOIN events ON ts BETWEEN lo AND hi GROUP BY preset""")
def date_presets(spark, sf):
    """Events in each preset range around a fixed day: one scan with conditional counts."""
    spans = dates.presets("2024-01-17")
    rows = table(spark, sf, "events").agg(*[F.count(F.when(F.col("ts").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")), 1)).alias(k) for k, (lo, hi) in spans.items()])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), F.col(k).alias("n")) for k in spans])).alias("x")).select("x.*")


@query("""
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, ((o_orderdate::DATE - date_trunc('week', date_trunc('month', o_orderdate))::DATE) // 7)::BIGINT AS week,
isodow(o_orderdate)::BIGINT AS weekday, greatest(0, count(*) OVER (PARTITION BY o_orderdate::DATE) - 3)::BIGINT AS hidden, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderdate, o_orderkey) <= 3 AS shown FROM orders""")
def month_grid(spark, sf):
    """A month calendar: week and weekday of each item, three shown for each day and the rest counted."""
    from pyspark.sql import Window

    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", day.alias("day"))
    first = F.trunc("day", "month")
    week = F.floor(F.date_diff("day", F.date_trunc("week", first).cast("date")) / 7)
    per = Window.partitionBy("day")
    return rows.select(
        "o_orderkey", F.date_format("day", "yyyy-MM").alias("month"), week.cast("long").alias("week"), (F.weekday("day") + 1).cast("long").alias("weekday"),
        F.greatest(F.lit(0), F.count("*").over(per) - 3).cast("long").alias("hidden"), (F.row_number().over(per.orderBy("o_orderdate", "o_orderkey")) <= 3).alias("shown"),
    )


@query("""
SELECT o_orderkey, epoch_us(CASE WHEN o_orderstatus = 'O' THEN o_orderdate ELSE o_orderdate + INTERVAL 2 DAY END)::BIGINT AS moment,
CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1997-06-15') > 900 THEN 'too-old' ELSE 'kept' END AS age,
strftime(o_orderdate + to_days(((5 - isodow(o_orderdate) + 7) % 7)::INT), '%Y-%m-%d') AS end_of_week FROM orders""")
def moments(spark, sf):
    """When items are, whether too old, and the Friday that ends their week."""
    at = micros(F.col("o_orderdate"))
    family = F.when(F.col("o_orderstatus") == "O", "event").otherwise("todo")
    old = F.date_diff(F.lit("1997-06-15").cast("date"), F.col("o_orderdate").cast("date")) > 900
    return table(spark, sf, "orders").select("o_orderkey", moment(family, at, at + 2 * DAY).alias("moment"), F.when(old, "too-old").otherwise("kept").alias("age"), dates.end_of_week(F.col("o_orderdate").cast("date")).cast("string").alias("end_of_week"))


@query("""
WITH t AS (SELECT event_id, (1 + event_id % 28) AS d, (1 + event_id % 12) AS m, 2020 + event_id % 6 AS y FROM events)
SELECT event_id, y::INT AS year, m::INT AS month, d::INT AS day, d <= 12 AND event_id % 3 > 0 AS assumed FROM t""")
def numeric_dates(spark, sf):
    """Dates read from texts written year first (unambiguous) or day first."""
    e = F.col("event_id")
    d, m, y = (1 + e % 28).cast("string"), (1 + e % 12).cast("string"), (2020 + e % 6).cast("string")
    said = F.when(e % 3 == 0, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.concat_ws("/", d, m, F.substring(y, 3, 2)))
    parsed = dates.parse(table(spark, sf, "events").select("event_id", said.alias("text")), order="dmy")
    return parsed.select("event_id", "parsed.year", "parsed.month", "parsed.day", F.col("parsed.order_assumed").alias("assumed"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts::DATE WHEN 1 THEN ts::DATE + 1 WHEN 2 THEN ts::DATE + (event_id % 9)::INT
 WHEN 3 THEN ts::DATE + ((1 - isodow(ts) + 7 - 1) % 7 + 1)::INT ELSE ts::DATE + ((5 - isodow(ts) + 7) % 7)::INT END::VARCHAR AS day FROM events""")
def relative_dates(spark, sf):
    """Relative texts in two languages, resolved against the event's day."""
    e = F.col("event_id")
    said = F.when(e % 5 == 0, "today at 10:30").when(e % 5 == 1, "reunión mañana").when(e % 5 == 2, F.concat(F.lit("in "), (e % 9).cast("string"), F.lit(" days"))).when(e % 5 == 3, "next Monday").otherwise("fin de la semana")
    parsed = dates.parse(table(spark, sf, "events").select("event_id", "ts", said.alias("text")))
    return parsed.select("event_id", dates.resolve(F.col("parsed"), F.col("ts").cast("date")).cast("string").alias("day"))
