"""Queries over trials, diffs, sync plans and the operation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import applying
from ..operators import trials as T
from ..sources.folders import settled
from ..sources.tables import table
from .registry import query


@query("""
WITH a AS (SELECT o_orderkey AS item, o_custkey AS title, o_totalprice AS price, o_orderstatus AS place FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey AS item, o_custkey AS title, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS place FROM orders WHERE o_orderkey % 10 <> 7)
SELECT coalesce(a.item, b.item) AS item, CASE WHEN b.item IS NULL THEN 'notFound' WHEN a.item IS NULL THEN 'new' WHEN a.price = b.price AND a.place = b.place THEN 'unchanged' ELSE 'changed' END AS state,
CASE WHEN a.item IS NULL OR b.item IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.price <> b.price THEN 'price' END, CASE WHEN a.place <> b.place THEN 'place' END) END AS fields
FROM a FULL OUTER JOIN b ON a.item = b.item""")
def trial_diff(spark, sf):
    """What a second run found otherwise than the stored one, and in which fields."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    a = o.where(key % 10 != 3).select(key.alias("item"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("place"))
    b = o.where(key % 10 != 7).select(key.alias("item"), F.when(key % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"), F.when(key % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("place"))
    return T.diff(a, b, "item", ["price", "place"])


@query("""
WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, event_id FROM events WHERE event_id % 2 = 0),
y AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, event_id FROM events WHERE event_id % 2 = 1)
SELECT coalesce(x.user_id, y.user_id) AS image, CASE WHEN y.event_id IS NULL THEN 'onlyInFirst' WHEN x.event_id IS NULL THEN 'onlyInSecond' ELSE 'both' END AS state, count(*)::BIGINT AS n
FROM x FULL OUTER JOIN y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.n = y.n GROUP BY 1, 2""")
def trial_vs_trial(spark, sf):
    """Two runs' findings paired by picture and title, the n-th with the n-th."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return T.paired(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).groupBy(F.col("user_id").alias("image"), "state").agg(F.count("*").alias("n"))


@query("""
WITH i AS (SELECT o_orderkey AS item, o_orderstatus <> 'F' AS ready, o_totalprice > 300000 AS gone, round(o_totalprice) AS hash FROM orders),
l AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice) - 1 ELSE round(o_totalprice) END AS hash, CASE o_orderkey % 11 WHEN 0 THEN 'removed' WHEN 1 THEN 'failed' ELSE 'synced' END AS state FROM orders WHERE o_orderkey % 3 > 0)
SELECT i.item, CASE WHEN l.item IS NULL THEN CASE WHEN ready AND NOT gone THEN 'create' ELSE 'skip' END WHEN l.state = 'removed' THEN 'skip' WHEN gone THEN 'remove' WHEN NOT ready THEN 'skip'
WHEN l.state = 'failed' OR l.hash <> i.hash THEN 'update' ELSE 'skip' END AS action FROM i LEFT JOIN l USING (item)""")
def sync_plan(spark, sf):
    """What to do with each item's outside entry, from its link, status and hash."""
    key, o = F.col("o_orderkey"), table(spark, sf, "orders")
    items = o.select(key.alias("item"), (F.col("o_orderstatus") != "F").alias("ready"), (F.col("o_totalprice") > 300000).alias("gone"), F.round("o_totalprice").alias("hash"))
    links = o.where(key % 3 > 0).select(key.alias("item"), (F.round("o_totalprice") - (key % 5 == 0).cast("int")).alias("linked"), F.when(key % 11 == 0, "removed").when(key % 11 == 1, "failed").otherwise("synced").alias("state"))
    return T.sync_plan(items, links)


@query("""
WITH r AS (SELECT event_id AS run, epoch_us(ts) AS t, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS changes FROM events),
g AS (SELECT *, lead(changes) OVER (ORDER BY t, run) AS next FROM r)
SELECT run, changes::INT AS changes FROM g WHERE changes > 0 OR next IS NULL OR next > 0""")
def sync_run_compaction(spark, sf):
    """Of neighbouring runs that changed nothing only the last is kept."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("run"), micros(F.col("ts")).alias("t"), F.when(F.col("event_type") == "click", 0).otherwise(1).alias("changes"))
    return T.compacted(rows)


@query("""
WITH o AS (SELECT event_id AS op, user_id % 200 AS item, event_type AS status, event_id % 7 = 0 AS undone FROM events)
SELECT item, max_by(status, op) AS status, count(*)::BIGINT AS ops FROM o WHERE NOT undone GROUP BY 1""")
def operation_replay(spark, sf):
    """Items' states by replaying the log without what was undone."""
    log = table(spark, sf, "events").select(F.col("event_id").alias("op"), (F.col("user_id") % 200).alias("item"), F.col("event_type").alias("status"), (F.col("event_id") % 7 == 0).alias("undone"))
    return log.where(~F.col("undone")).groupBy("item").agg(F.max_by("status", "op").alias("status"), F.count("*").alias("ops"))


@query("""
WITH t AS (SELECT event_id % 50 AS trial, CASE event_id % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'skipped' END AS state FROM events WHERE event_id % 50 > 2 OR event_id % 4 > 0)
SELECT trial, count(*) FILTER (state = 'waiting')::BIGINT AS waiting, count(*) FILTER (state = 'done')::BIGINT AS done, CASE WHEN count(*) FILTER (state = 'waiting') = 0 THEN 'finished' ELSE 'running' END AS status FROM t GROUP BY 1""")
def trial_states(spark, sf):
    """A trial is finished when none of its pictures waits."""
    e = F.col("event_id")
    state = F.when(e % 4 == 0, "waiting").when(e % 4 == 1, "done").when(e % 4 == 2, "failed").otherwise("skipped")
    rows = table(spark, sf, "events").where((e % 50 > 2) | (e % 4 > 0)).select((e % 50).alias("trial"), state.alias("state"))
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return rows.groupBy("trial").agg(n("waiting").alias("waiting"), n("done").alias("done")).withColumn("status", F.when(F.col("waiting") == 0, "finished").otherwise("running"))


@query("""
SELECT o_custkey AS item, sha256(string_agg(o_orderkey || ':' || o_orderstatus || ':' || floor(epoch(o_orderdate))::BIGINT, '|' ORDER BY o_orderkey)) AS hash FROM orders GROUP BY 1""")
def canonical_hash(spark, sf):
    """A hash of an item's entries in canonical form, times in whole seconds."""
    part = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus", F.floor(micros(F.col("o_orderdate")) / 1_000_000).cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))), lambda x: x["p"])
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.sha2(F.array_join(rows, "|"), 256).alias("hash"))


#: Order lines as a plan: every fourth joins an item, its neighbour's step, a new item, or one that may be a copy.
PLAN = """(SELECT l_orderkey AS image, CAST(l_linenumber AS INT) AS step, l_orderkey * 8 + CAST(l_linenumber AS INT) AS finding, max(l_partkey) AS part, max(l_suppkey) AS supp, max(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY l_orderkey, CAST(l_linenumber AS INT))"""
TARGET = "CASE part % 4 WHEN 0 THEN 'existing' WHEN 1 THEN CASE WHEN step > 1 THEN 'same' ELSE 'new' END WHEN 2 THEN 'new' ELSE 'possible' END"


def plan_of(spark, sf):
    lines = spark.sql(f"SELECT *, {TARGET} AS target FROM {PLAN.replace('FROM lineitem', 'FROM {lineitem}')} p", lineitem=table(spark, sf, "lineitem"))
    other = F.when(F.col("target") == "same", F.col("step") - 1).when(F.col("target") != "new", F.col("supp") % 60)
    return lines.withColumn("other", other.cast("string")).withColumn("title", F.concat(F.lit("t"), (F.col("part") % 3).cast("string")))


def merged_items(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").where((key < 60) & (key % 11 != 5)).select(key.alias("item"), F.when(key % 7 == 3, key - 1).alias("merged_into"))


@query(f"""WITH RECURSIVE plan AS (SELECT *, {TARGET} AS target FROM {PLAN} p),
items AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 7 = 3 THEN p_partkey - 1 END AS merged_into FROM part WHERE p_partkey < 60 AND p_partkey % 11 <> 5),
chain AS (SELECT item, item AS at_, 1 AS n FROM items UNION ALL SELECT c.item, i.merged_into, n + 1 FROM chain c JOIN items i ON i.item = c.at_ WHERE i.merged_into IS NOT NULL AND n < 10),
live AS (SELECT c.item, c.at_ AS live FROM chain c JOIN items i ON i.item = c.at_ AND i.merged_into IS NULL),
ends AS (SELECT p.finding, p.image, p.step AS at_ FROM plan p WHERE q % 3 = 0 UNION ALL SELECT e.finding, e.image, e.at_ - 1 FROM ends e JOIN plan p ON p.image = e.image AND p.step = e.at_ AND p.target = 'same'),
last AS (SELECT finding, image, min(at_) AS at_ FROM ends GROUP BY 1, 2)
SELECT l.finding, CASE WHEN p.target IN ('new', 'possible') OR live.live IS NOT NULL THEN 'applied' WHEN l.at_ = own.step AND own.target = 'existing' THEN 'item gone' ELSE 'no longer applies' END AS outcome,
  CASE WHEN p.target IN ('new', 'possible') THEN 'new:' || p.finding ELSE live.live::VARCHAR END AS item
FROM last l JOIN plan own ON own.finding = l.finding LEFT JOIN plan p ON p.image = l.image AND p.step = l.at_ LEFT JOIN live ON live.item = p.supp % 60 AND p.target = 'existing'
UNION ALL SELECT -o_orderkey, 'no longer applies', NULL FROM orders WHERE o_orderkey % 97 = 0""")
def trial_applied(spark, sf):
    """What applying the chosen findings of a trial does: the item that each becomes part of, or why it is left out."""
    plan = settled(plan_of(spark, sf).select("image", "step", "finding", "title", "target", "other", "q"))
    gone = table(spark, sf, "orders").where("o_orderkey % 97 = 0").select((-F.col("o_orderkey")).alias("finding"))
    chosen = plan.where("q % 3 = 0").select("finding").unionByName(gone)
    made, told = applying.apply_selected(plan, chosen, merged_items(spark, sf))
    return told.join(made.select("finding", "item"), "finding", "left")
