"""Queries over items as they follow from sightings, and over the library's files and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import library as L
from ..sources.tables import table
from .registry import query


@query("""
WITH e AS (SELECT *, user_id % 150 AS item, floor(epoch_us(ts) / 1000000.0)::BIGINT AS t FROM events), s AS (SELECT * FROM e WHERE event_id % 5 > 0),
o AS (SELECT item, event_id AS sighting, t, unnest(['title', 'start', 'due']) AS field, unnest(['T' || (event_id % 7), CASE WHEN event_id % 3 > 0 THEN (t + 3600)::VARCHAR END, CASE WHEN event_id % 4 = 0 THEN (t + 7200)::VARCHAR END]) AS value,
 CASE event_id % 6 WHEN 0 THEN 0 WHEN 5 THEN CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END ELSE 1 END AS r FROM s),
f AS (SELECT item, field, max_by(value, (r, t, sighting)) AS value, max_by(sighting, (r, t, sighting)) AS sighting FROM o WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT item, event_type AS kind, count(*) AS n, max((t, event_id)) AS last FROM s GROUP BY 1, 2), m AS (SELECT item, max_by(kind, (n, last)) AS kind FROM k GROUP BY 1),
a AS (SELECT item, min(t) AS first_seen, max(t) AS last_seen, count(*)::BIGINT AS sightings, max_by(event_id, (t, event_id)) AS latest FROM s GROUP BY 1),
x AS (SELECT a.*, m.kind, ti.value AS title, st.value::BIGINT AS start, du.value::BIGINT AS due, coalesce(st.sighting, du.sighting, latest) % 3 AS z FROM a JOIN m USING (item)
 LEFT JOIN f ti ON ti.item = a.item AND ti.field = 'title' LEFT JOIN f st ON st.item = a.item AND st.field = 'start' LEFT JOIN f du ON du.item = a.item AND du.field = 'due')
SELECT item, kind, title, start, NULL::BIGINT AS "end", due, ['UTC', 'Asia/Tokyo', 'Asia/Kolkata'][z + 1] AS zone, (DATE '1970-01-01' + floor((coalesce(start, due) + [0, 32400, 19800][z + 1]) / 86400.0)::INT)::VARCHAR AS day, first_seen, last_seen, sightings FROM x""")
def recomputed_items(spark, sf):
    """Items rebuilt from their sightings and observations."""
    e = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (e % n + 1).cast("int"))
    seen = table(spark, sf, "events").where(e % 5 > 0).select(
        (F.col("user_id") % 150).alias("item"), e.alias("sighting"), F.floor(micros(F.col("ts")) / 1_000_000).alias("at"), F.col("event_type").alias("kind"), pick(3, "UTC", "Asia/Tokyo", "Asia/Kolkata").alias("zone"), pick(3, 0, 32400, 19800).alias("offset"),
    )
    s, at = F.col("sighting"), F.col("at")
    source = F.when(s % 6 == 0, "inferred").when((s % 6 == 5) & (s % 31 == 0), "user").otherwise("read")
    values = F.array(
        F.struct(F.lit("title").alias("field"), F.concat(F.lit("T"), (s % 7).cast("string")).alias("value")), F.struct(F.lit("start").alias("field"), F.when(s % 3 > 0, (at + 3600).cast("string")).alias("value")),
        F.struct(F.lit("due").alias("field"), F.when(s % 4 == 0, (at + 7200).cast("string")).alias("value")),
    )
    observed = seen.withColumn("source", source).withColumn("o", values).select("item", "sighting", "at", "source", F.explode("o").alias("o")).select("item", "sighting", "o.field", "o.value", "source", "at")
    return L.recomputed(seen.drop("source"), observed, seen.select("item").limit(0))


@query("""
SELECT o_orderkey AS item, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'changed-after-approval' END, CASE WHEN o_totalprice < 60000 THEN 'low-confidence' END, CASE WHEN o_custkey % 3 = 0 THEN 'inferred-time' END,
 CASE WHEN o_orderkey % 4 >= 2 THEN 'possibly-cancelled' END, CASE WHEN o_orderstatus = 'P' THEN 'possible-duplicate' END) AS reasons FROM orders""")
def review_refresh(spark, sf):
    """Why items wait for their user."""
    k = F.col("o_orderkey")
    reasons = L.review(k % 5 == 0, F.col("o_totalprice") / 100_000, F.col("o_custkey") % 3 == 0, k % 4, F.col("o_orderstatus") == "P")
    return table(spark, sf, "orders").select(k.alias("item"), F.array_join(reasons, ",").alias("reasons"))


@query("""
WITH f AS (SELECT doc_id AS image FROM documents WHERE doc_id % 4 > 0), i AS (SELECT doc_id AS image, doc_id % 3 = 0 AS missing FROM labels)
SELECT coalesce(f.image, i.image) AS image, CASE WHEN i.image IS NULL THEN 'orphan' WHEN f.image IS NULL AND NOT missing THEN 'now missing' WHEN f.image IS NOT NULL AND missing THEN 'found again' WHEN f.image IS NULL THEN 'missing' ELSE 'stored' END AS state
FROM f FULL OUTER JOIN i ON f.image = i.image""")
def file_sweep(spark, sf):
    """Files without rows, and rows without files."""
    files = table(spark, sf, "documents").where("doc_id % 4 > 0").select(F.col("doc_id").alias("image"))
    return L.file_state(files, table(spark, sf, "labels").select(F.col("doc_id").alias("image"), (F.col("doc_id") % 3 == 0).alias("missing")))


@query("""
WITH c AS (SELECT doc_id AS sighting, max(quality) AS v FROM labels GROUP BY 1) SELECT d.doc_id AS sighting, CASE WHEN v < 1 THEN 'older' ELSE 'none' END AS why FROM documents d LEFT JOIN c ON c.sighting = d.doc_id WHERE v IS NULL OR v < 1""")
def evidence_backfill(spark, sf):
    """Sightings that still need a cut-out, or a new one."""
    return L.to_cut(table(spark, sf, "documents").select(F.col("doc_id").alias("sighting")), table(spark, sf, "labels").select(F.col("doc_id").alias("sighting"), F.col("quality").alias("version")), 1)


@query("SELECT count(DISTINCT o_custkey)::BIGINT AS events, count(*)::BIGINT AS images, sum(o_orderkey)::BIGINT AS bytes FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cleanup_preview(spark, sf):
    """What a clean-up would remove."""
    images = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("bytes"))
    return L.cleanup(images, table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("event")))


@query("""
WITH c AS (SELECT c_custkey AS context, CASE c_custkey % 40 WHEN 7 THEN ' ' ELSE CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || (c_custkey // 3) END AS name, CASE WHEN c_custkey % 5 = 0 THEN ['x'] ELSE ['mail'] END AS hints FROM customer),
p AS (SELECT context, CASE WHEN trim(name) = '' THEN 'no name' WHEN min(context) OVER (PARTITION BY lower(trim(name))) < context THEN 'name taken' WHEN hints[1] = 'x' THEN 'hint too short' END AS problem FROM c)
SELECT * FROM p WHERE problem IS NOT NULL""")
def context_rules(spark, sf):
    """Contexts with names that are taken, or hints that are too short."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 40 == 7, " ").otherwise(F.concat(F.when(k % 2 == 0, F.upper(seg)).otherwise(F.lower(seg)), F.floor(k / 3).cast("string")))
    return L.context_problems(table(spark, sf, "customer").select(k.alias("context"), name.alias("name"), F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("mail"))).alias("hints")))


@query("""
WITH s AS (SELECT conv_id AS image, turn AS n, role AS text FROM conversations), r AS (SELECT conv_id AS image, turn + 100 AS n, 'new' AS text FROM conversations WHERE turn = 0), i AS (SELECT DISTINCT image FROM s WHERE image % 3 = 0)
SELECT image, count(*)::BIGINT AS lines, max(n)::BIGINT AS last FROM (SELECT * FROM s WHERE image NOT IN (SELECT image FROM i) UNION ALL SELECT * FROM r WHERE image IN (SELECT image FROM i)) GROUP BY 1""")
def lines_replaced(spark, sf):
    """The library's lines after some pictures were read again."""
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("image"), F.col("turn").alias("n"), F.col("role").alias("text"))
    read = s.where("n = 0").select("image", (F.col("n") + 100).alias("n"), F.lit("new").alias("text"))
    out = L.replaced_lines(s, read, s.where("image % 3 = 0").select("image"))
    return out.groupBy("image").agg(F.count("*").alias("lines"), F.max("n").alias("last"))
