"""Queries over stored records: validation, provenance, evidence, windows, export and housekeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators.reading import loggable
from ..sources.tables import table
from .registry import query


@query("""
WITH c AS (SELECT l_orderkey AS finding, list_sort(list_distinct(list(l_partkey % 12))) AS cited, (l_orderkey % 9)::BIGINT AS lines FROM lineitem GROUP BY 1)
SELECT finding, array_to_string(list_filter(cited, lambda x: x >= 1 AND x <= lines), ',') AS kept, len(list_filter(cited, lambda x: x < 1 OR x > lines))::BIGINT AS dropped FROM c
WHERE len(list_filter(cited, lambda x: x >= 1 AND x <= lines)) > 0""")
def citation_check(spark, sf):
    """Cited lines that exist, distinct and in order; findings without any are dropped."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("finding")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 12)).alias("cited"))
    c = c.withColumn("lines", F.col("finding") % 9)
    kept = F.filter("cited", lambda x: (x >= 1) & (x <= F.col("lines")))
    out = c.select("finding", kept.alias("kept"), (F.size("cited") - F.size(kept)).cast("long").alias("dropped")).where(F.size("kept") > 0)
    return out.select("finding", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "dropped")


@query("""
SELECT l_orderkey AS finding, round(CASE WHEN bool_or(l_returnflag = 'R') THEN least(min(l_discount * 10), 0.5) ELSE min(l_discount * 10) END, 6) AS confidence FROM lineitem GROUP BY 1""")
def finding_confidence(spark, sf):
    """The least confidence of the cited lines, at most a half where anything was inferred."""
    least = F.min(F.col("l_discount") * 10)
    capped = F.when(F.bool_or(F.col("l_returnflag") == "R"), F.least(least, F.lit(0.5))).otherwise(least)
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("finding")).agg(F.round(capped, 6).alias("confidence"))


@query("""
WITH s AS (SELECT DISTINCT lower(n_name) AS x FROM nation WHERE length(n_name) >= 4), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, n FROM l WHERE len(string_split(line, ' ')) <= 12 AND NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(line), s.x))""")
def log_sanitiser(spark, sf):
    """Lines short enough to be logged that hold none of the sensitive strings (nation names here)."""
    bad = table(spark, sf, "nation").select(F.lower("n_name").alias("x")).where(F.length("x") >= 4).distinct()
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return loggable(lines.withColumn("n", F.col("n") + 1), "line", bad, "x").select("doc_id", "n")


@query("""
WITH w AS (SELECT w, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1), s AS (SELECT DISTINCT lower(w) AS x FROM w WHERE n = 1),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, n FROM l WHERE len(string_split(line, ' ')) <= 12 AND NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(line), s.x))""")
def log_sanitiser_words(spark, sf):
    """The same for strings that grow with the corpus: the words of single documents. No line holds one with a line break."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).where(~F.col("w").contains("\n") & (F.col("w") != ""))
    words = words.groupBy("w").agg((F.min("doc_id") == F.max("doc_id")).alias("single"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return loggable(lines.withColumn("n", F.col("n") + 1), "line", words.where("single"), "w").select("doc_id", "n")


@query("""
SELECT l_orderkey AS capture, min_by(l_linenumber, (l_suppkey, l_linenumber))::BIGINT AS "window" FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 4 GROUP BY 1""")
def active_window(spark, sf):
    """The first visible candidate window of the front process."""
    shown = table(spark, sf, "lineitem").where((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 4))
    return shown.groupBy(F.col("l_orderkey").alias("capture")).agg(F.min_by("l_linenumber", F.struct("l_suppkey", "l_linenumber")).cast("long").alias("window"))


@query("""
SELECT o_custkey AS item, CASE min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END) WHEN 1 THEN 'running' WHEN 2 THEN 'waiting' WHEN 3 THEN 'analysed' ELSE 'none' END AS state FROM orders GROUP BY 1""")
def capture_states(spark, sf):
    """A capture's state: running before waiting before analysed."""
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 3).otherwise(4)
    best = F.min(rank)
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.when(best == 1, "running").when(best == 2, "waiting").when(best == 3, "analysed").otherwise("none").alias("state"))


@query("""
SELECT a.s_suppkey AS a, b.s_suppkey AS b, len(list_filter(range(1, length(a.s_name) + 1), lambda k: substr(a.s_name, k, 1) <> substr(b.s_name, k, 1)))::BIGINT AS different
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 AND length(a.s_name) = length(b.s_name)
WHERE len(list_filter(range(1, length(a.s_name) + 1), lambda k: substr(a.s_name, k, 1) <> substr(b.s_name, k, 1))) BETWEEN 1 AND 3""")
def look_alike_names(spark, sf):
    """Neighbouring names of one length that differ in one to three letters."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_name").alias("x"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.col("s_name").alias("y"))
    places = F.sequence(F.lit(1), F.length("x"))
    n = F.size(F.filter(places, lambda k: F.col("x").substr(k, F.lit(1)) != F.col("y").substr(k, F.lit(1))))
    return a.join(b, "a").where((F.length("x") == F.length("y")) & (F.length("x") > 0)).select("a", "b", n.cast("long").alias("different")).where(F.col("different").between(1, 3))


@query("""
SELECT event_id, least(720, greatest(30, round(value * 60 / 40 / 15) * 15))::BIGINT AS minutes, (event_id % 12 + CASE WHEN event_id % 2 = 1 AND event_id % 12 < 7 THEN 12 ELSE 0 END)::BIGINT AS hour FROM events""")
def block_durations(spark, sf):
    """Pixels to minutes in quarters of an hour, 30 to 720; bare small hours are afternoon."""
    e = F.col("event_id")
    minutes = F.least(F.lit(720), F.greatest(F.lit(30), F.round(F.col("value") * 60 / 40 / 15) * 15)).cast("long")
    hour = (e % 12 + F.when((e % 2 == 1) & (e % 12 < 7), 12).otherwise(0)).cast("long")
    return table(spark, sf, "events").select("event_id", minutes.alias("minutes"), hour.alias("hour"))


@query("""
SELECT doc_id, s::BIGINT AS start, least(n_chars, s + 1000)::BIGINT AS stop FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(1, n_chars - 200), 800)) AS s FROM documents)""")
def tile_spans(spark, sf):
    """A length covered by tiles of 1,000 with an overlap of 200."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.col("n_chars") - 200) - 1, F.lit(800).cast("long"))
    return table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(starts).alias("start")).select("doc_id", "start", F.least(F.col("n_chars"), F.col("start") + 1000).alias("stop"))


@query("""
WITH t AS (SELECT event_id, (event_id % 24) || ':00-' || ((event_id + 1) % 24) || ':30' AS x FROM events)
SELECT event_id, regexp_extract(x, '([0-9]{1,2}:[0-9]{2}) ?[-–] ?([0-9]{1,2}:[0-9]{2})', 1) AS start, regexp_extract(x, '([0-9]{1,2}:[0-9]{2}) ?[-–] ?([0-9]{1,2}:[0-9]{2})', 2) AS stop FROM t""")
def time_range_split(spark, sf):
    """A range of times as its two ends."""
    e = F.col("event_id")
    said = F.concat((e % 24).cast("string"), F.lit(":00-"), ((e + 1) % 24).cast("string"), F.lit(":30"))
    pattern = "([0-9]{1,2}:[0-9]{2}) ?[-–] ?([0-9]{1,2}:[0-9]{2})"
    return table(spark, sf, "events").select("event_id", F.regexp_extract(said, pattern, 1).alias("start"), F.regexp_extract(said, pattern, 2).alias("stop"))


@query("""
WITH m AS (SELECT p_partkey AS old, p_partkey - p_partkey % 5 AS kept FROM part)
SELECT coalesce(kept, l_partkey) AS item, count(*)::BIGINT AS sightings, count(DISTINCT l_partkey)::BIGINT AS merged FROM lineitem LEFT JOIN m ON old = l_partkey GROUP BY 1""")
def merge_remap(spark, sf):
    """Sightings re-pointed to the items that were kept."""
    kept = table(spark, sf, "part").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - F.col("p_partkey") % 5).alias("kept"))
    lines = table(spark, sf, "lineitem").select("l_partkey")
    return lines.join(kept, F.col("l_partkey") == F.col("old"), "left").groupBy(F.coalesce("kept", "l_partkey").alias("item")).agg(F.count("*").alias("sightings"), F.countDistinct("l_partkey").alias("merged"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'no cut-out' WHEN d.doc_id IS NULL THEN 'sighting gone' ELSE 'both' END AS state
FROM (SELECT doc_id FROM documents WHERE doc_id % 4 > 0) d FULL OUTER JOIN (SELECT doc_id FROM labels WHERE doc_id % 3 > 0) l ON d.doc_id = l.doc_id""")
def evidence_entries(spark, sf):
    """Sightings with their cut-outs, and cut-outs whose sighting is gone."""
    d = table(spark, sf, "documents").where("doc_id % 4 > 0").select("doc_id", F.lit(1).alias("d"))
    l = table(spark, sf, "labels").where("doc_id % 3 > 0").select("doc_id", F.lit(1).alias("l"))
    state = F.when(F.col("l").isNull(), "no cut-out").when(F.col("d").isNull(), "sighting gone").otherwise("both")
    return d.join(l, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query("""
SELECT count(*)::BIGINT AS lines, sum(l_linenumber)::BIGINT AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')""")
def cascade_survivors(spark, sf):
    """Rows of pictures that a clean-up leaves: children follow their pictures."""
    kept = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")
    return table(spark, sf, "lineitem").join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(F.count("*").alias("lines"), F.sum("l_linenumber").cast("long").alias("total"))


@query("""
SELECT o_custkey AS item, count(*)::BIGINT AS n, string_agg(o_orderkey || '=' || o_orderstatus, ';' ORDER BY o_orderdate DESC, o_orderkey DESC) AS history FROM orders GROUP BY 1""")
def item_export(spark, sf):
    """An item with all its observations, newest first, as one row of an export."""
    seen = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")), asc=False)
    said = F.array_join(F.transform(seen, lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit("="), x["o_orderstatus"])), ";")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n"), said.alias("history"))


@query("""
WITH a AS (SELECT l_orderkey AS item, l_partkey % 3 AS value, epoch_us(l_shipdate) AS u, l_linenumber AS n FROM lineitem)
SELECT item, n::BIGINT AS n, value::BIGINT AS value, row_number() OVER (PARTITION BY item ORDER BY u DESC, n DESC, value DESC) = 1 AS current, count(*) OVER (PARTITION BY item, value)::BIGINT AS agreeing FROM a""")
def provenance_rows(spark, sf):
    """Every observation of a field, which one is current, and how many agree with it."""
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 3).cast("long").alias("value"), micros(F.col("l_shipdate")).alias("u"), F.col("l_linenumber").cast("long").alias("n"))
    newest = F.row_number().over(Window.partitionBy("item").orderBy(F.col("u").desc(), F.col("n").desc(), F.col("value").desc())) == 1
    return a.select("item", "n", "value", newest.alias("current"), F.count("*").over(Window.partitionBy("item", "value")).alias("agreeing"))


@query("""
SELECT p.page_id, CASE WHEN trim(host) = '' AND trim(title) = '' THEN 'none' WHEN trim(title) = '' THEN trim(host) WHEN trim(host) = '' THEN trim(title) ELSE trim(host) || ' — ' || trim(title) END AS label
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE regexp_extract(url, '^[a-z]+://([^/:]+)', 1) END AS host, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages) p""")
def window_labels(spark, sf):
    """An app and its window's title as one label, or either, or none."""
    p = F.col("page_id")
    host = F.trim(F.when(p % 5 == 0, " ").otherwise(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)))
    title = F.trim(F.when(p % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    parts = F.filter(F.array(host, title), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", F.when(F.size(parts) == 0, "none").otherwise(F.array_join(parts, " — ")).alias("label"))


@query("""
SELECT c_nationkey::BIGINT AS context, count(*)::BIGINT AS items, count(*) FILTER (c_acctbal < 0)::BIGINT AS waiting, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS bytes FROM customer GROUP BY 1""")
def context_counts(spark, sf):
    """Items, waiting items and sizes by context."""
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("context")).agg(
        F.count("*").alias("items"), F.count(F.when(bal < 0, 1)).alias("waiting"), F.round(F.sum(F.when(bal > 0, bal).otherwise(0.0)), 2).alias("bytes")
    )
