"""Queries over the queue, notices and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..sources.cases import replace_keys
from ..sources.folders import work_folder
from ..sources.tables import table
from ..streaming import notices as N
from .registry import query

HOUR = 3_600_000_000


@query("""
SELECT epoch_us(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_equals_batch(spark, sf):
    """Hourly counts kept by a stream over the event files."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    glob = path[:-1] + "[t]"  # a pattern, as a stream's plain path has to be a folder
    stream = spark.readStream.schema(schema).parquet(glob).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    done = N.run_to_end(N.counted(stream), work_folder(spark, "stream"))
    return done.select(micros(F.col("w.start")).alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t)::BIGINT AS first, (max(t) + 21600000000)::BIGINT AS fires, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_notice(spark, sf):
    """A notice after six hours of quiet, without a ceiling."""
    rows = table(spark, sf, "events").select("user_id", micros(F.col("ts")).alias("t"))
    return N.notice_windows(rows, "user_id", "t", quiet=6 * HOUR, ceiling=1 << 60)


@query()
def session_notice_ceiling(spark, sf):
    """The same with a ceiling of a day from a notice's first item."""
    rows = table(spark, sf, "events").select("user_id", micros(F.col("ts")).alias("t"))
    return N.notice_windows(rows, "user_id", "t", quiet=6 * HOUR, ceiling=24 * HOUR)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w(user_id, n, event_id, t, last, ok) AS (SELECT user_id, n, event_id, t, t, true FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, CASE WHEN e.t - w.last >= 21600000000 THEN e.t ELSE w.last END, e.t - w.last >= 21600000000 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, t::BIGINT AS t FROM w WHERE ok""")
def debounce_leading(spark, sf):
    """Requests accepted if six hours have passed since the last accepted one."""
    rows = table(spark, sf, "events").select("user_id", micros(F.col("ts")).alias("t"), "event_id")
    return N.debounced(rows, "user_id", "t", "event_id", least=6 * HOUR)


@query("""
SELECT event_id, CASE WHEN a >= 3 OR permanent THEN 'failed' ELSE 'waiting' END AS state, CASE WHEN a >= 3 OR permanent THEN 0 ELSE t + CASE a WHEN 1 THEN 10000000 ELSE 60000000 END END::BIGINT AS not_before
FROM (SELECT event_id, 1 + event_id % 3 AS a, event_id % 13 = 0 AS permanent, epoch_us(ts) AS t FROM events)""")
def retry_schedule(spark, sf):
    """After a failure: wait 10 s, then 60 s, then give up; at once if the failure is permanent."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", (1 + e % 3).alias("a"), (e % 13 == 0).alias("permanent"), micros(F.col("ts")).alias("t"))
    over = (F.col("a") >= 3) | F.col("permanent")
    wait = F.when(F.col("a") == 1, N.WAITS[0]).otherwise(N.WAITS[1])
    return rows.select("event_id", F.when(over, "failed").otherwise("waiting").alias("state"), F.when(over, 0).otherwise(F.col("t") + wait).cast("long").alias("not_before"))


@query("""
SELECT o_orderpriority AS priority, min_by(o_orderkey, (epoch_us(o_orderdate), o_orderkey))::BIGINT AS next_job, count(*)::BIGINT AS waiting FROM orders
WHERE o_orderstatus = 'O' AND (o_custkey % 4 > 0 OR o_orderdate <= TIMESTAMP '1996-01-01') GROUP BY 1""")
def queue_next(spark, sf):
    """The next runnable job of each priority, oldest first."""
    runnable = (F.col("o_custkey") % 4 > 0) | (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz"))
    jobs = table(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & runnable)
    return jobs.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next_job"), F.count("*").alias("waiting"))


@query("""
SELECT doc_id, 'new' AS origin, quality::INT AS quality FROM labels WHERE doc_id % 3 = 0 UNION ALL
SELECT doc_id, 'old', (1 - quality)::INT FROM labels WHERE doc_id % 3 > 0""")
def upsert_rows(spark, sf):
    """Rows replaced by key: what a new run brings takes the place of what was there."""
    labels = table(spark, sf, "labels")
    old = labels.select("doc_id", F.lit("old").alias("origin"), (1 - F.col("quality")).cast("int").alias("quality"))
    new = labels.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("origin"), F.col("quality").cast("int").alias("quality"))
    return replace_keys(old, new, "doc_id")
