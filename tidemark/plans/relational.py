"""Queries over joins, filters, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, MINUTE, micros
from ..sources.tables import table
from .registry import query


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf):
    """Anti-join: never analysed."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def seen_semi(spark, sf):
    """Semi-join: seen before."""
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf, "orders").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT count(*)::BIGINT AS waiting FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unread_anti(spark, sf):
    """Waiting count: stored pictures without a read."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("waiting"))


@query("""
SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'""")
def three_way_inner(spark, sf):
    """Inner joins of three tables."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    found = o.where("o_orderstatus = 'O'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return found.select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("""
SELECT p.page_id, coalesce(e.event_id, -1) AS event_id, coalesce(c.turn, -1) AS turn, d.source FROM pages p LEFT JOIN events e ON p.page_id = e.event_id
LEFT JOIN documents d ON d.doc_id = p.page_id LEFT JOIN conversations c ON c.conv_id = p.page_id AND c.turn = p.page_id % 4""")
def left_outer_chain(spark, sf):
    """A chain of left outer joins, one on a composite key."""
    p, e, d, c = (table(spark, sf, t) for t in ("pages", "events", "documents", "conversations"))
    out = p.join(e, p.page_id == e.event_id, "left").join(d, d.doc_id == p.page_id, "left")
    out = out.join(c, (c.conv_id == p.page_id) & (c.turn == p.page_id % 4), "left")
    return out.select(p.page_id, F.coalesce(e.event_id, F.lit(-1)).alias("event_id"), F.coalesce(c.turn, F.lit(-1)).alias("turn"), d.source)


def in_spans(points: DataFrame, spans: DataFrame, bin_width: int) -> DataFrame:
    """(id, at) rows inside any of the closed (start, stop) spans of their group.

    Both sides are cut into bins of ``bin_width``, so the join is on equal keys and only neighbours are compared.
    """
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("stop") / bin_width))))
    keyed = points.withColumn("bin", F.floor(F.col("at") / bin_width))
    inside = keyed.join(binned.select(F.col("grp").alias("g"), F.col("bin").alias("b"), "start", "stop"), (F.col("grp") == F.col("g")) & (F.col("bin") == F.col("b")) & F.col("at").between(F.col("start"), F.col("stop")), "left_semi")
    return inside.drop("bin")


@query("""
WITH s AS (SELECT o_custkey % 150 AS grp, epoch_us(o_orderdate) % 2592000000000 AS start, epoch_us(o_orderdate) % 2592000000000 + 7200000000 AS stop FROM orders)
SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM s WHERE s.grp = e.user_id % 150 AND epoch_us(e.ts) % 2592000000000 BETWEEN s.start AND s.stop)""")
def in_any_span(spark, sf):
    """Range join: events inside any covered span of their context."""
    month = 30 * DAY
    at = micros(F.col("o_orderdate")) % month
    spans = table(spark, sf, "orders").select((F.col("o_custkey") % 150).alias("grp"), at.alias("start"), (at + 120 * MINUTE).alias("stop"))
    points = table(spark, sf, "events").select("event_id", (F.col("user_id") % 150).alias("grp"), (micros(F.col("ts")) % month).alias("at"))
    return in_spans(points, spans, DAY // 4).select("event_id")


@query("""
WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey + 1) AS a, greatest(l_partkey, l_suppkey + 1) AS b FROM lineitem WHERE l_partkey <> l_suppkey + 1)
SELECT me, count(*)::BIGINT AS partners, min(other)::BIGINT AS first_partner FROM (SELECT a AS me, b AS other FROM p UNION ALL SELECT b, a FROM p) GROUP BY me""")
def pair_partner(spark, sf):
    """Unordered pairs read from either side."""
    l, s = F.col("l_partkey"), F.col("l_suppkey") + 1
    pairs = table(spark, sf, "lineitem").where(l != s).select(F.least(l, s).alias("a"), F.greatest(l, s).alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other")))).alias("x")).select("x.*")
    return both.groupBy("me").agg(F.count("*").alias("partners"), F.min("other").alias("first_partner"))


def live(pointers: DataFrame, hops: int = 10) -> DataFrame:
    """(id, target) rows followed up to ``hops`` times; rows without a target stay where they are.

    Pointers are squared: each round doubles the hops a row has made, so ten hops take four joins.
    """
    steps = [1 << k for k in reversed(range(hops.bit_length())) if hops >> k & 1]
    power, at = {1: pointers.select("id", F.coalesce("target", "id").alias("target"))}, pointers.select("id", F.col("id").alias("at"))
    for k in range(1, hops.bit_length()):
        half = power[1 << (k - 1)]
        power[1 << k] = half.alias("x").join(half.alias("y"), F.col("x.target") == F.col("y.id"), "left").select(F.col("x.id"), F.coalesce("y.target", "x.target").alias("target"))
    for k in steps:
        at = at.alias("x").join(power[k].alias("y"), F.col("x.at") == F.col("y.id"), "left").select(F.col("x.id"), F.coalesce("y.target", "x.at").alias("at"))
    return at


@query("""
WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey - 1 END AS target FROM part WHERE p_partkey > 0),
c(id, spot, n) AS (SELECT id, id, 0 FROM p UNION ALL SELECT c.id, p.target, n + 1 FROM c JOIN p ON p.id = c.spot WHERE p.target IS NOT NULL AND n < 10 AND p.target IN (SELECT id FROM p))
SELECT id, min(spot)::BIGINT AS spot FROM c GROUP BY id""")
def merged_chain(spark, sf):
    """Merge pointers followed to the row that still lives."""
    parts = table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_partkey") - 1).alias("target"))
    there = parts.select(F.col("id").alias("known"))
    kept = parts.join(there, F.col("target") == F.col("known"), "left").select("id", F.col("known").alias("target"))
    return live(kept).withColumnRenamed("at", "spot")


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND (o_orderpriority IS NOT DISTINCT FROM '1-URGENT' OR o_totalprice > 200000)
AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31 23:59:59'""")
def list_filter(spark, sf):
    """Status set, null-safe equality and an inclusive range."""
    kept = F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority").eqNullSafe("1-URGENT") | (F.col("o_totalprice") > 200000))
    inside = F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31 23:59:59").cast("timestamp_ntz"))
    return table(spark, sf, "orders").where(kept & inside).select("o_orderkey", "o_orderdate")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey)::BIGINT AS place FROM orders ORDER BY place LIMIT 50 OFFSET 20""")
def list_sorted_page(spark, sf):
    """A page of the list: undated rows last, ties by id; limit and offset."""
    when = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    page = table(spark, sf, "orders").select("o_orderkey", when.alias("w")).orderBy(F.col("w").asc_nulls_last(), "o_orderkey").offset(20).limit(50)
    return page.withColumn("place", (F.row_number().over(Window.orderBy(F.col("w").asc_nulls_last(), "o_orderkey")) + 20).cast("long")).select("o_orderkey", "place")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts < TIMESTAMP '2024-01-25' - INTERVAL 10 DAY GROUP BY event_type")
def retention_cut(spark, sf):
    """What a retention of ten days would remove, strictly before the cut."""
    return table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf):
    """The newest run of each job, by an aggregate that combines before the shuffle."""
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(newest.alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("SELECT o_custkey, o_orderkey, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_per_group(spark, sf):
    """Three best of each group; Spark prunes to three rows for each group before the shuffle."""
    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(best)).where("k <= 3").select("o_custkey", "o_orderkey", "k")


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1)::BIGINT AS gap FROM events")
def lag_gaps(spark, sf):
    """Gaps between neighbours."""
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    rows = table(spark, sf, "events").select("event_id", "user_id", micros(F.col("ts")).alias("at"))
    return rows.select("event_id", F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(-1)).alias("gap"))


@query("""
SELECT key, 'both' AS side FROM (SELECT doc_id AS key FROM labels INTERSECT SELECT page_id FROM pages) UNION ALL
SELECT key, 'pages only' FROM (SELECT page_id AS key FROM pages EXCEPT SELECT doc_id FROM labels)""")
def set_operations(spark, sf):
    """Union, intersection and difference of key sets."""
    a, b = table(spark, sf, "labels").select(F.col("doc_id").alias("key")), table(spark, sf, "pages").select(F.col("page_id").alias("key"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.subtract(a).withColumn("side", F.lit("pages only")))


@query("""
WITH s AS (SELECT DISTINCT lower(c_name) AS x FROM customer UNION SELECT DISTINCT lower(n_name) FROM nation)
SELECT count(*)::BIGINT AS strings, min(x) AS first_string FROM s WHERE length(x) >= 4""")
def sensitive_strings(spark, sf):
    """The union of strings that logs must not hold."""
    names = table(spark, sf, "customer").select(F.lower("c_name").alias("x")).unionByName(table(spark, sf, "nation").select(F.lower("n_name").alias("x")))
    return names.distinct().where(F.length("x") >= 4).agg(F.count("*").alias("strings"), F.min("x").alias("first_string"))
