"""Queries over users' actions, the queue of jobs, and entries in an outside calendar.

The driver tables stand for the library's: events for the log of operations and for jobs, orders for items, lineitem for
sightings. The rules themselves are in ``operators``; adapters here only name columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import actions as A
from ..operators import entries as E
from ..operators import jobs as J
from ..sources.tables import table
from .registry import query

LOG = """log AS (SELECT event_id AS op, user_id % 300 AS item, CASE WHEN event_id % 11 < 2 THEN 'dismiss' WHEN event_id % 11 = 2 THEN 'restore' WHEN event_id % 11 = 3 THEN 'merge'
 WHEN event_id % 11 = 4 THEN 'approve' WHEN event_id % 11 = 5 THEN 'unapprove' WHEN event_id % 11 < 8 THEN 'edit' WHEN event_id % 11 = 8 THEN 'unlock' ELSE 'undo' END AS kind,
 user_id * 7 % 300 AS other, CASE WHEN event_id % 2 = 0 THEN 'title' ELSE 'place' END AS field, 'v' || (event_id % 5) AS value, event_id - 1 - event_id % 4 AS undoes, event_id % 4 > 0 AS by_user FROM events),
done AS (SELECT * FROM log WHERE kind <> 'undo' AND op NOT IN (SELECT undoes FROM log WHERE kind = 'undo'))"""
STATUS_OF = "CASE last WHEN 'dismiss' THEN 'dismissed' WHEN 'merge' THEN 'merged' ELSE 'active' END"


def log_of(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    m = e % 11
    kind = (
        F.when(m < 2, "dismiss").when(m == 2, "restore").when(m == 3, "merge").when(m == 4, "approve").when(m == 5, "unapprove").when(m < 8, "edit").when(m == 8, "unlock").otherwise("undo")
    )
    return table(spark, sf, "events").select(
        e.alias("op"), (u % 300).alias("item"), kind.alias("kind"), (u * 7 % 300).alias("other"), F.when(e % 2 == 0, "title").otherwise("place").alias("field"),
        F.concat(F.lit("v"), (e % 5).cast("string")).alias("value"), (e - 1 - e % 4).alias("undoes"), (e % 4 > 0).alias("by_user"),
    )


@query(f"""
WITH {LOG}, s AS (SELECT item, max_by(kind, op) FILTER (kind IN ('dismiss', 'restore', 'merge')) AS last, max_by(CASE WHEN kind = 'merge' THEN other ELSE -1 END, op) FILTER (kind IN ('dismiss', 'restore', 'merge')) AS m,
 bool_or(by_user) AS touched, max_by(CASE WHEN kind = 'approve' THEN op ELSE -1 END, op) FILTER (kind IN ('approve', 'unapprove')) AS a, count(*)::BIGINT AS ops FROM done GROUP BY 1)
SELECT item, {STATUS_OF} AS status, CASE WHEN m >= 0 THEN m END AS merged_into, touched, CASE WHEN a >= 0 THEN a END AS approved_op, ops FROM s""")
def item_states(spark, sf):
    """Status, merge, touch and approval of items after replaying the log without what was undone."""
    return A.item_states(log_of(spark, sf))


@query(f"""
WITH {LOG} SELECT item, field, value FROM (SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY op DESC) AS n FROM done WHERE kind IN ('edit', 'unlock')) WHERE n = 1 AND kind = 'edit'""")
def item_locks(spark, sf):
    """Fields that users set and did not let go of."""
    return A.locks(log_of(spark, sf))


@query(f"""
WITH {LOG}, u AS (SELECT undoes, min(op) AS undone FROM log WHERE kind = 'undo' GROUP BY 1),
b AS (SELECT x.op, max_by(y.kind, y.op) AS last, max_by(y.other, y.op) AS other FROM log x LEFT JOIN (SELECT log.*, undone FROM log LEFT JOIN u ON undoes_of = log.op) y
 ON y.item = x.item AND y.op < x.op AND y.kind IN ('dismiss', 'restore', 'merge') AND (y.undone IS NULL OR y.undone > x.op) GROUP BY 1)
SELECT b.op, log.item, {STATUS_OF} AS status, CASE WHEN last = 'merge' THEN b.other END AS merged_into FROM b JOIN log ON log.op = b.op""".replace("LEFT JOIN u ON undoes_of = log.op", "LEFT JOIN u ON u.undoes = log.op"))
def states_before(spark, sf):
    """What each operation's item was just before it."""
    return A.states_before(log_of(spark, sf))


@query(f"WITH {LOG} SELECT op, kind FROM done WHERE by_user ORDER BY op DESC LIMIT 1")
def undo_target(spark, sf):
    """The operation that an undo would take back."""
    return A.undo_target(log_of(spark, sf))


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 40 = 13 THEN p_partkey + 5 WHEN p_partkey % 40 > 0 AND p_partkey % 40 <> 24 THEN p_partkey - 1 WHEN p_partkey % 400 = 0 THEN -p_partkey - 1 END AS merged_into FROM part),
c AS (SELECT item, item AS at_, 1 AS n FROM s UNION ALL SELECT c.item, s.merged_into, n + 1 FROM c JOIN s ON s.item = c.at_ WHERE s.merged_into IS NOT NULL AND n < 10)
SELECT s.item, max(e.item) AS live FROM s LEFT JOIN c ON c.item = s.item LEFT JOIN s e ON e.item = c.at_ AND e.merged_into IS NULL GROUP BY 1""")
def merge_survivors(spark, sf):
    """Items at the ends of chains of merges; chains here are long, end in a circle, or lead to an item that is gone."""
    key = F.col("p_partkey")
    to = F.when(key % 40 == 13, key + 5).when((key % 40 > 0) & (key % 40 != 24), key - 1).when(key % 400 == 0, -key - 1)
    return A.survivors(table(spark, sf, "part").select(key.alias("item"), to.alias("merged_into")))


@query("""
WITH s AS (SELECT o_custkey AS selection, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'dismissed' ELSE 'merged' END AS status, o_totalprice > 60000 AS review FROM orders)
SELECT selection, bool_and(review AND status = 'active') AS approve, count(*) = 2 AND bool_and(status <> 'merged') AS merge, bool_and(status = 'active') AS dismiss, bool_and(status = 'dismissed') AS restore FROM s GROUP BY 1""")
def action_eligibility(spark, sf):
    """What may be done to selections of items."""
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("merged")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("selection"), F.col("o_orderkey").alias("item"), status.alias("status"), (F.col("o_totalprice") > 60000).alias("needs_review"))
    return A.may(rows, "selection")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS item, l_orderkey * 10 + l_linenumber AS sighting, l_linenumber > 2 AND l_orderkey % 3 = 0 AS chosen FROM lineitem)
SELECT CASE WHEN chosen THEN -item - 1 ELSE item END AS item, count(*)::BIGINT AS sightings, s.item IN (SELECT item FROM s WHERE chosen) AS apart FROM s GROUP BY s.item, chosen""")
def split_items(spark, sf):
    """Sightings of items after some went to new ones, and which items are to be kept apart."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sighting"), "l_linenumber").distinct()
    chosen = rows.where("l_linenumber > 2 AND item % 3 = 0").select("sighting", (-F.col("item") - 1).alias("new_item"))
    after, pairs = A.split(rows.select("item", "sighting"), chosen)
    apart = pairs.select(F.col("item_a").alias("item")).union(pairs.select("item_b")).withColumn("apart", F.lit(True))
    return after.groupBy("item").agg(F.count("*").alias("sightings")).join(apart, "item", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))


@query("""
SELECT event_id, CASE f WHEN 'title' THEN CASE WHEN trim(v) = '' THEN 'empty title' END WHEN 'end' THEN CASE WHEN try_cast(v AS BIGINT) IS NULL THEN 'no time' WHEN v::BIGINT < 500 THEN 'end before start' END
 WHEN 'start' THEN CASE WHEN try_cast(v AS BIGINT) IS NULL THEN 'no time' END WHEN 'all_day' THEN CASE WHEN v NOT IN ('true', 'false') THEN 'neither true nor false' END WHEN 'place' THEN NULL ELSE 'unknown field' END AS problem
FROM (SELECT event_id, ['title', 'end', 'start', 'all_day', 'place', 'colour'][event_id % 6 + 1] AS f, [' ', 'true', '12', '900', 'x'][event_id % 5 + 1] AS v FROM events)""")
def edit_problems(spark, sf):
    """Why values may not be set."""
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % n + 1).cast("int"))
    field, value = pick(6, "title", "end", "start", "all_day", "place", "colour"), pick(5, " ", "true", "12", "900", "x")
    return table(spark, sf, "events").select("event_id", A.edit_problem(field, value, F.lit(500)).alias("problem"))


@query("""
SELECT o_orderkey AS item, '{"allDay":' || (o_orderkey % 6 = 0) || CASE WHEN o_orderkey % 5 = 0 THEN ',"end":' || (floor(epoch(o_orderdate))::BIGINT + 7200) ELSE '' END
 || ',"start":' || floor(epoch(o_orderdate))::BIGINT || ',"title":"T' || o_custkey || '"}' AS snapshot FROM orders""")
def approval_snapshots(spark, sf):
    """The fields that approvals vouch for."""
    i = items_of(spark, sf).where("start0 is not null")
    end = F.when(F.col("item") % 5 == 0, F.col("start0") + 7200)
    return i.select("item", A.approval_snapshot(F.col("title"), F.col("start0"), end, F.col("all_day"), F.lit(None).cast("long")).alias("snapshot"))


JOBS = """jobs AS (SELECT event_id AS job, user_id AS image, ['waiting', 'running', 'finished', 'failed', 'waiting'][event_id % 5 + 1] AS state, CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS not_before,
 (event_id % 4)::BIGINT AS attempts, ['analyse', 'reread', 'export'][event_id % 3 + 1] AS kind FROM events)"""


def jobs_of(spark, sf):
    e = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (e % n + 1).cast("int"))
    return table(spark, sf, "events").select(
        e.alias("job"), F.col("user_id").alias("image"), pick(5, "waiting", "running", "finished", "failed", "waiting").alias("state"), F.when(e % 3 == 0, e * 10).alias("not_before"),
        (e % 4).cast("long").alias("attempts"), pick(3, "analyse", "reread", "export").alias("kind"),
    )


@query(f"WITH {JOBS} SELECT min(not_before) FILTER (state = 'waiting' AND not_before > 700) AS wake FROM jobs")
def next_wake_up(spark, sf):
    """When the queue has to look again."""
    return J.next_wake(jobs_of(spark, sf), 700).withColumnRenamed("at", "wake")


@query(f"WITH {JOBS} SELECT state, count(*)::BIGINT AS n, sum(attempts)::BIGINT AS attempts FROM (SELECT CASE WHEN state = 'running' THEN 'waiting' ELSE state END AS state, attempts FROM jobs) GROUP BY 1")
def crash_recovery(spark, sf):
    """The queue after a crash."""
    return J.recovered(jobs_of(spark, sf)).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query(f"""
WITH {JOBS}, r AS (SELECT *, CASE WHEN state = 'running' AND job % 2 = 0 THEN ['success', 'transient', 'transient', 'permanent', 'unavailable', 'transient', 'success'][job % 7 + 1] END AS said, job * 3 AS t FROM jobs)
SELECT job, image, kind, CASE WHEN said = 'success' THEN 'finished' WHEN said = 'permanent' OR (said = 'transient' AND attempts + 1 >= 3) THEN 'failed' WHEN said IS NOT NULL THEN 'waiting' ELSE state END AS state,
 CASE WHEN said = 'transient' AND attempts + 1 < 3 THEN t + CASE WHEN attempts + 1 = 1 THEN 10 ELSE 60 END WHEN said = 'unavailable' THEN NULL ELSE not_before END AS not_before,
 attempts + (coalesce(said, '') = 'transient')::INT AS attempts FROM r""")
def job_transitions(spark, sf):
    """Jobs after some running ones reported: finished, failed for good, waiting for a time, or for the server."""
    jobs = jobs_of(spark, sf)
    outcomes = F.array(*[F.lit(x) for x in ("success", "transient", "transient", "permanent", "unavailable", "transient", "success")])
    return J.after_run(jobs, jobs.where("job % 2 = 0").select("job", F.get(outcomes, (F.col("job") % 7).cast("int")).alias("outcome"), (F.col("job") * 3).alias("at")))


@query(f"WITH {JOBS} SELECT job, image, kind, CASE WHEN state = 'failed' THEN 'waiting' ELSE state END AS state, CASE WHEN state <> 'failed' THEN not_before END AS not_before, CASE WHEN state = 'failed' THEN 0 ELSE attempts END AS attempts FROM jobs WHERE state <> 'finished'")
def retry_and_clear(spark, sf):
    """Failed jobs wait again, finished ones go."""
    return J.cleared(J.retried(jobs_of(spark, sf)))


@query(f"""
WITH {JOBS} SELECT c_custkey AS image, (c_custkey % 97)::BIGINT AS captured FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
 AND c_custkey NOT IN (SELECT image FROM jobs WHERE kind IN ('analyse', 'force', 'reread') AND state IN ('waiting', 'running'))""")
def analysis_backlog(spark, sf):
    """Pictures that still have to be analysed and are not pending."""
    images = table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), (F.col("c_custkey") % 97).alias("captured"), (F.col("c_acctbal") > 0).alias("stored"))
    return J.backlog(images, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("image")), jobs_of(spark, sf))


@query(f"""
WITH {JOBS} SELECT c_custkey AS image, (c_custkey % 97)::BIGINT AS captured FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderkey % 9) < 8)
 AND c_custkey NOT IN (SELECT image FROM jobs WHERE kind IN ('analyse', 'force', 'reread') AND state IN ('waiting', 'running'))""")
def library_reread(spark, sf):
    """Pictures to read again with a newer version."""
    images = table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), (F.col("c_custkey") % 97).alias("captured"), (F.col("c_acctbal") > 0).alias("stored"))
    return J.to_reread(images, table(spark, sf, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 9).alias("version")), jobs_of(spark, sf), 8)


@query("""
WITH g AS (SELECT user_id AS key, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t) AS run FROM g)
SELECT key, max(t) + 86400000000 AS run_at, count(*)::BIGINT AS changes FROM r GROUP BY key, run""")
def debounce_trailing(spark, sf):
    """A run after each burst of changes has been quiet for a day."""
    return J.trailing(table(spark, sf, "events").select(F.col("user_id").alias("key"), micros(F.col("ts")).alias("at")), 86_400_000_000).withColumnRenamed("at", "run_at")


@query("""
WITH c AS (SELECT user_id % 50 AS key, event_id AS t, (event_id // 7 % 3)::BIGINT AS waiting, (event_id // 11 % 2)::BIGINT AS running FROM events),
p AS (SELECT *, lag(waiting) OVER w AS a, lag(running) OVER w AS b FROM c WINDOW w AS (PARTITION BY key ORDER BY t)) SELECT key, t, waiting, running FROM p WHERE a IS NULL OR a <> waiting OR b <> running""")
def queue_progress(spark, sf):
    """The states of a queue, each change once."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("key"), e.alias("at"), (F.floor(e / 7) % 3).alias("waiting"), (F.floor(e / 11) % 2).alias("running"))
    return J.progress(rows).withColumnRenamed("at", "t")


@query("SELECT doc_id, least(16384, greatest(3072, 20 * (length(text) - length(replace(text, chr(10), '')) + 1)) + CASE WHEN doc_id % 2 = 0 THEN 4096 ELSE 0 END)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def answer_limits(spark, sf):
    """Tokens that the answer on each document's lines may take."""
    lines = F.size(F.split("text", "\n"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", J.answer_limit(lines, F.col("doc_id") % 2 == 0).cast("long").alias("tokens"))


@query("""
WITH t AS (SELECT DISTINCT o_custkey AS image FROM orders), s AS (SELECT 1::INT AS trial, image, CASE WHEN c_acctbal > 0 THEN 'waiting' ELSE 'skipped' END AS state FROM t LEFT JOIN customer ON c_custkey = image)
SELECT trial, image, CASE WHEN state = 'waiting' AND image % 3 = 0 THEN 'done' WHEN state = 'waiting' THEN 'skipped' ELSE state END AS state FROM s""")
def trial_lifecycle(spark, sf):
    """A trial's pictures: created, some done, the rest cancelled."""
    images = table(spark, sf, "orders").select(F.col("o_custkey").alias("image"))
    rows = J.trial_jobs(1, images, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("image")))
    return J.trial_cancelled(J.trial_marked(rows, rows.where("image % 3 = 0").select("trial", "image", F.lit("done").alias("result"))))


@query("SELECT count(*) FILTER (o_orderpriority <> '1-URGENT' OR o_orderstatus NOT IN ('F', 'O'))::BIGINT AS n FROM orders")
def out_of_date_count(spark, sf):
    """Pictures read by another model or older prompts."""
    return J.out_of_date(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("prompt")), "1-URGENT", ("F", "O"))


ITEMS = """items AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 > 0 THEN 'event' ELSE 'todo' END AS family, 'T' || o_custkey AS title, CASE WHEN o_custkey % 4 > 0 THEN 'C' || (o_custkey % 4) END AS context,
 CASE WHEN o_orderkey % 2 = 0 THEN 'P' || (o_orderkey % 9) ELSE '' END AS place, CASE WHEN o_orderkey % 7 > 0 THEN t END AS start, CASE WHEN o_orderkey % 5 = 0 THEN t + 7200 * (o_orderkey % 11) END AS "end",
 CASE WHEN o_orderkey % 4 = 0 THEN t + 86400 END AS due, NULL::BIGINT AS remind, o_orderkey % 6 = 0 AS all_day, [0, 32400, 19800][o_custkey % 3 + 1] AS shift,
 CASE o_orderstatus WHEN 'P' THEN 'merged' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 1 THEN 'dismissed' ELSE 'active' END ELSE 'active' END AS status, o_totalprice > 150000 AS needs_review
 FROM (SELECT *, floor(epoch(o_orderdate))::BIGINT AS t FROM orders)),
entries AS (SELECT *, CASE WHEN family = 'event' THEN 'event' ELSE 'reminder' END AS kind, CASE WHEN context IS NULL THEN title ELSE '[' || context || '] ' || title END AS e_title,
 CASE WHEN family = 'event' THEN CASE WHEN all_day THEN floor((start + shift) / 86400.0)::BIGINT * 86400 ELSE start END END AS e_start,
 CASE WHEN family = 'event' THEN CASE WHEN all_day THEN CASE WHEN floor(("end" + shift) / 86400.0) > floor((start + shift) / 86400.0) THEN floor(("end" + shift) / 86400.0)::BIGINT * 86400 END ELSE coalesce("end", start + 3600) END END AS e_end,
 CASE WHEN family <> 'event' THEN CASE WHEN all_day THEN floor((coalesce(due, start) + shift) / 86400.0)::BIGINT * 86400 ELSE coalesce(due, start) END END AS e_due,
 CASE WHEN family = 'event' AND place <> '' THEN place END AS e_place FROM items)"""


def items_of(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.floor(micros(F.col("o_orderdate")) / 1_000_000)
    dismissed = F.when((F.col("o_orderstatus") == "O") & (k % 5 == 1), "dismissed").otherwise("active")
    return table(spark, sf, "orders").select(
        k.alias("item"), F.when(k % 3 > 0, "event").otherwise("todo").alias("family"), F.concat(F.lit("T"), c.cast("string")).alias("title"),
        F.when(c % 4 > 0, F.concat(F.lit("C"), (c % 4).cast("string"))).alias("context"), F.when(k % 2 == 0, F.concat(F.lit("P"), (k % 9).cast("string"))).otherwise("").alias("place"),
        t.alias("start0"), F.when(k % 7 > 0, t).alias("start"), F.when(k % 5 == 0, t + 7200 * (k % 11)).alias("end"), F.when(k % 4 == 0, t + 86400).alias("due"), F.lit(None).cast("long").alias("remind"),
        (k % 6 == 0).alias("all_day"), F.element_at(F.array(F.lit("UTC"), F.lit("Asia/Tokyo"), F.lit("Asia/Kolkata")), (c % 3 + 1).cast("int")).alias("zone"),
        F.when(F.col("o_orderstatus") == "P", "merged").otherwise(dismissed).alias("status"), (F.col("o_totalprice") > 150000).alias("needs_review"),
    )


@query(f"WITH {ITEMS} SELECT item, kind, e_title AS title, e_start AS start, e_end AS \"end\", e_due AS due, all_day, e_place AS location FROM entries")
def rendered_entries(spark, sf):
    """Items as entries of an outside calendar."""
    made = E.rendered(items_of(spark, sf))
    return made.select("item", *[F.col(f"entry.{f}").alias(f) for f in ("kind", "title", "start", "end", "due", "all_day", "location")])


@query("""
SELECT event_id, s + 43200 AS seconds, floor((s + 43200 + shift) / 86400.0)::BIGINT * 86400 AS day, floor((s + 43200 + shift) / 86400.0)::BIGINT * 86400 - shift AS back
FROM (SELECT event_id, floor(epoch(ts))::BIGINT AS s, [0, 32400, 19800][event_id % 3 + 1] AS shift FROM events)""")
def all_day_as_utc(spark, sf):
    """Instants as calendar days in UTC, and back to the start of the day in their zone."""
    zone = F.element_at(F.array(F.lit("UTC"), F.lit("Asia/Tokyo"), F.lit("Asia/Kolkata")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", (F.floor(micros(F.col("ts")) / 1_000_000) + 43200).alias("seconds"), zone.alias("zone")).withColumn("day", E.local_day(F.col("seconds"), F.col("zone")))
    return rows.select("event_id", "seconds", "day", E.day_moment(F.col("day"), F.col("zone")).alias("back"))


#: What the calendar holds of every item with a link: some entries changed by hand.
STORED = """kept AS (SELECT *, item % 13 AS k FROM entries WHERE item % 4 > 0),
now_ AS (SELECT *, CASE WHEN k = 1 THEN e_title || ' new' WHEN k = 2 THEN ' ' ELSE e_title END AS n_title, CASE WHEN k = 3 THEN e_start + 3600 ELSE e_start END AS n_start,
 CASE WHEN k = 4 THEN 'Hall' WHEN k = 5 THEN NULL ELSE e_place END AS n_place, CASE WHEN k = 6 THEN e_due + 60 ELSE e_due END AS n_due FROM kept),
edits AS (SELECT item, CASE WHEN k = 1 THEN 'title' END AS a, CASE WHEN kind = 'event' AND k = 3 AND e_start IS NOT NULL THEN 'start' END AS b,
 CASE WHEN kind = 'event' AND (k = 4 OR k = 5 AND e_place IS NOT NULL) THEN 'place' END AS c, CASE WHEN kind <> 'event' AND k = 6 AND e_due IS NOT NULL THEN 'due' END AS d FROM now_),
said AS (SELECT item, concat_ws(',', a, b, c, d) AS fields FROM edits)"""


def stored_of(items):
    e, k = F.col("entry"), F.col("item") % 13
    title = F.when(k == 1, F.concat(e["title"], F.lit(" new"))).when(k == 2, " ").otherwise(e["title"])
    now = F.struct(
        e["kind"].alias("kind"), title.alias("title"), F.when(k == 3, e["start"] + 3600).otherwise(e["start"]).alias("start"), e["end"].alias("end"),
        F.when(k == 6, e["due"] + 60).otherwise(e["due"]).alias("due"), e["alarm"].alias("alarm"), e["all_day"].alias("all_day"),
        F.when(k == 4, "Hall").when(k != 5, e["location"]).alias("location"),
    )
    return E.rendered(items).where("item % 4 > 0").withColumn("now", now)


@query(f"WITH {ITEMS}, {STORED} SELECT item, fields FROM said WHERE fields <> ''")
def outside_edits(spark, sf):
    """Fields that were changed in the outside calendar."""
    rows = stored_of(items_of(spark, sf))
    edits = E.outside_edits(F.col("entry"), F.col("now"), F.col("context"), F.col("zone"))
    return rows.select("item", F.array_join(F.transform(edits, lambda x: x["field"]), ",").alias("fields")).where("fields <> ''")


@query(f"""
WITH {ITEMS}, {STORED}, links AS (SELECT item, ['synced', 'failed', 'removed', 'completed', 'removed-by-user', 'synced'][item % 6 + 1] AS state, CASE WHEN item % 8 = 1 THEN 'old' WHEN kind = 'event' THEN 'cal' ELSE 'list' END AS box FROM kept),
x AS (SELECT e.*, l.state, l.box, CASE WHEN e.item % 9 = 1 THEN 'other' ELSE l.box END AS in_box, e.item % 17 <> 5 AS there, s.fields, CASE WHEN kind = 'event' THEN 'cal' ELSE 'list' END AS wanted,
 status = 'active' AND NOT needs_review AS ready, CASE WHEN family = 'event' THEN start ELSE coalesce(due, start) END AS moment FROM entries e LEFT JOIN links l USING (item) LEFT JOIN said s USING (item)),
c AS (SELECT *, CASE WHEN kind = 'event' AND start IS NULL THEN 'skip:no-date' WHEN moment < 800000000 THEN 'skip:too-old' ELSE 'create:' END AS made FROM x),
d AS (SELECT item, CASE WHEN state IS NULL THEN CASE WHEN ready THEN made WHEN status = 'active' THEN 'skip:inbox' ELSE 'skip:not-ready' END
 WHEN state = 'removed-by-user' THEN CASE WHEN ready THEN 'skip:removed-by-user' END WHEN state = 'completed' THEN 'skip:completed' WHEN state = 'removed' THEN CASE WHEN ready THEN made END
 WHEN status <> 'active' THEN 'remove:' || status WHEN NOT ready THEN 'skip:inbox' WHEN NOT there THEN 'mark-removed:deleted' WHEN in_box <> box AND in_box <> wanted THEN 'mark-removed:moved'
 WHEN kind <> 'event' AND item % 10 = 3 THEN 'complete:' WHEN fields <> '' THEN 'adopt:' || fields WHEN box <> wanted THEN 'move:' || wanted WHEN state = 'synced' THEN 'skip:unchanged' ELSE 'update:' END AS y FROM c)
SELECT item, split_part(y, ':', 1) AS action, CASE WHEN y LIKE 'update:%' THEN '' ELSE nullif(split_part(y, ':', 2), '') END AS reason FROM d WHERE y IS NOT NULL""")
def sync_table(spark, sf):
    """Everything one sync would do."""
    items, k = items_of(spark, sf), F.col("item")
    rows = stored_of(items)
    state = F.element_at(F.array(*map(F.lit, ("synced", "failed", "removed", "completed", "removed-by-user", "synced"))), (k % 6 + 1).cast("int"))
    box = F.when(k % 8 == 1, "old").when(F.col("family") == "event", "cal").otherwise("list")
    links = rows.select("item", state.alias("state"), box.alias("container"), F.col("entry").alias("written"), E.entry_hash(F.col("entry")).alias("hash"))
    stored = rows.where("item % 17 <> 5").select("item", F.when(k % 9 == 1, "other").otherwise(box).alias("container"), (k % 10 == 3).alias("completed"), F.col("now").alias("entry"))
    return E.sync_actions(items, links, stored, "cal", "list", 800_000_000 + 30 * 86_400, 30)


@query(f"""
WITH {ITEMS}, l AS (SELECT l_orderkey AS item, 'line ' || l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem)
SELECT i.item, coalesce(string_agg(line, '|' ORDER BY n), '') AS evidence FROM items i LEFT JOIN l ON l.item = i.item AND n <= 3 WHERE i.item % 10 = 3 OR status = 'active' AND NOT needs_review GROUP BY 1""")
def sync_sources(spark, sf):
    """What a sync looks at: linked or ready items with three lines of evidence."""
    items = items_of(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("line"), F.col("l_linenumber").alias("at"))
    out = E.sync_sources(items, items.where("item % 10 = 3").select("item"), lines)
    return out.select("item", F.array_join("evidence", "|").alias("evidence"))
