"""Queries over aggregations, review state and absences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import DAY, micros
from ..operators.absence import absences, possibly_cancelled
from ..operators.resolve import alias_spellings, people_union, resolve_fields
from ..sources.tables import table
from .registry import query


@query("SELECT event_type AS kind, count(*) FILTER (value < 20)::BIGINT AS waiting, count(*) FILTER (value BETWEEN 20 AND 50)::BIGINT AS running, count(*) FILTER (value > 50)::BIGINT AS finished FROM events GROUP BY 1")
def queue_counts(spark, sf):
    """Jobs by kind and state."""
    n = lambda c: F.count(F.when(c, 1))
    v = F.col("value")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(n(v < 20).alias("waiting"), n(v.between(20, 50)).alias("running"), n(v > 50).alias("finished"))


@query("SELECT user_id, coalesce(nullif(event_type, 'click'), 'none') AS reason, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, user_id, reason LIMIT 20")
def failure_top20(spark, sf):
    """The twenty commonest failures (a report of twenty rows)."""
    reason = F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("none"))
    return table(spark, sf, "events").groupBy("user_id", reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id", "reason").limit(20)


@query("SELECT l_orderkey, count(*)::BIGINT AS sightings, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def having_multi(spark, sf):
    """Groups of several rows, with their ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string")), ",")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sightings"), ids.alias("ids")).where("sightings > 1")


@query("""SELECT count(*)::BIGINT AS items, max(epoch_us(ts))::BIGINT AS newest, sum((value > 50)::INT)::BIGINT AS waiting, coalesce(sum(CASE WHEN event_type = 'none' THEN 1 END), 0)::BIGINT AS sized,
count(DISTINCT user_id)::BIGINT AS users, min(epoch_us(ts)) FILTER (ts > TIMESTAMP '2024-01-10')::BIGINT AS next_wake FROM events""")
def fingerprint(spark, sf):
    """One row that changes whenever the items do."""
    at = micros(F.col("ts"))
    return table(spark, sf, "events").agg(
        F.count("*").alias("items"), F.max(at).alias("newest"), F.sum((F.col("value") > 50).cast("int")).alias("waiting"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "none", 1)), F.lit(0)).alias("sized"), F.countDistinct("user_id").alias("users"),
        F.min(F.when(F.col("ts") > F.lit("2024-01-10").cast("timestamp_ntz"), at)).alias("next_wake"),
    )


@query("""
WITH k AS (SELECT user_id, event_type, count(*) AS n, max(epoch_us(ts)) AS latest FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, latest DESC, event_type) AS r FROM k) WHERE r = 1""")
def kind_mode_latest(spark, sf):
    """The commonest kind, ties to the one seen last."""
    kinds = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(micros(F.col("ts"))).alias("latest"))
    best = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("latest").desc(), "event_type")
    return kinds.withColumn("r", F.row_number().over(best)).where("r = 1").select("user_id", F.col("event_type").alias("kind"))


@query("""
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*)::BIGINT AS docs, round(avg(quality), 6) AS quality, max(n_chars)::BIGINT AS longest
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""")
def summary_grouping_sets(spark, sf):
    """Totals overall, by language and by source in one pass."""
    joined = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    joined.createOrReplaceTempView("_labelled")
    return spark.sql("""SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS docs, round(avg(quality), 6) AS quality, max(n_chars) AS longest
        FROM _labelled GROUP BY GROUPING SETS ((), (lang), (source))""")


@query("SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'view')::BIGINT AS view, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY 1")
def pivot_states(spark, sf):
    """Counts by state as columns."""
    kinds = ["click", "view", "purchase"]
    wide = table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return wide.na.fill(0, kinds)


@query("SELECT l_suppkey, list_sort(list(l_quantity))[(count(*) // 2 + 1)::INT] AS median, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def medians_and_fit(spark, sf):
    """Upper median and a straight-line fit."""
    middle = F.element_at(F.array_sort(F.collect_list("l_quantity")), (F.count("*") / 2).cast("int") + 1)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        middle.alias("median"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept")
    )


@query("""
WITH v AS (SELECT user_id, sum((event_id % 3 = 0)::INT) AS dmy, sum((event_id % 3 = 1)::INT) AS mdy FROM events GROUP BY 1)
SELECT user_id, CASE WHEN dmy > mdy THEN 'dmy' WHEN mdy > dmy THEN 'mdy' ELSE 'none' END AS vote FROM v""")
def dominant_vote(spark, sf):
    """Date order by majority; a tie decides nothing."""
    d, m = F.sum((F.col("event_id") % 3 == 0).cast("int")), F.sum((F.col("event_id") % 3 == 1).cast("int"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(d > m, "dmy").when(m > d, "mdy").otherwise("none").alias("vote"))


@query("""
SELECT band, count(*)::BIGINT AS n, round(avg(quality), 6) AS precision FROM (SELECT *, CASE WHEN c < 0.6 THEN 'low' WHEN c <= 0.85 THEN 'mid' ELSE 'high' END AS band
FROM (SELECT quality, (n_chars % 101) / 100.0::DOUBLE AS c FROM documents JOIN labels USING (doc_id))) GROUP BY band""")
def confidence_bands(spark, sf):
    """Precision by confidence band."""
    c = (F.col("n_chars") % 101) / F.lit(100.0)
    band = F.when(c < 0.6, "low").when(c <= 0.85, "mid").otherwise("high")
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return joined.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("precision"))


def observations(spark, sf):
    """Orders as items, their lines as sightings: (item, field, value, source, confidence, at, seq); without a part the value is empty, without a flag the source null."""
    value = F.concat(F.lit("room "), (F.col("l_partkey") % 7).cast("string"))
    source = F.when(F.col("l_returnflag") == "N", "read").when(F.col("l_returnflag").isNotNull(), "inferred")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.lit("place").alias("field"), F.coalesce(value, F.lit("")).alias("value"),
        source.alias("source"), F.lit(0.9).alias("confidence"), micros(F.col("l_shipdate")).alias("at"), F.col("l_linenumber").alias("seq"),
    )
    return lines


@query("""
SELECT l_orderkey AS item, 'room ' || (l_partkey % 7) AS value, CASE WHEN l_returnflag = 'N' THEN 'read' ELSE 'inferred' END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'N') DESC, l_shipdate DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1""")
def field_survivorship(spark, sf):
    """The value of a field: what was read beats what was inferred, then the newest."""
    found = resolve_fields(observations(spark, sf))
    return found.select("item", F.nullif("value", F.lit("")).alias("value"), F.coalesce("source", F.lit("inferred")).alias("source"))


@query("""
WITH f AS (SELECT l_orderkey AS item, lower(l_returnflag || ' ' || l_linestatus) AS form, l_returnflag || ' ' || l_linestatus AS person, l_shipdate, l_linenumber FROM lineitem),
u AS (SELECT *, row_number() OVER (PARTITION BY item, form ORDER BY l_shipdate, l_linenumber, person) AS k FROM f)
SELECT item, string_agg(person, ', ' ORDER BY l_shipdate, l_linenumber, person) AS people FROM u WHERE k = 1 GROUP BY item""")
def people_merged(spark, sf):
    """People of all sightings, oldest first, each once whatever its case."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("person"), micros(F.col("l_shipdate")).alias("at"), F.col("l_linenumber").alias("seq"))
    return people_union(rows)


@query("""
WITH f AS (SELECT p_brand AS item, lower(p_type) AS form, p_type AS spelling, p_partkey FROM part),
c AS (SELECT item, min_by(form, p_partkey) AS chosen FROM f GROUP BY 1),
u AS (SELECT f.*, row_number() OVER (PARTITION BY item, form ORDER BY p_partkey) AS k FROM f)
SELECT u.item, u.spelling FROM u JOIN c USING (item) WHERE k = 1 AND form <> chosen""")
def alias_first_spelling(spark, sf):
    """Other titles of an item in the spelling seen first, without the chosen one."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("item"), F.lower("p_type").alias("form"), F.col("p_type").alias("spelling"), F.col("p_partkey").alias("at"))
    chosen = rows.groupBy("item").agg(F.min_by("form", "at").alias("chosen"))
    return alias_spellings(rows, chosen)


SEEN = """
s AS (SELECT user_id AS item, user_id % 5 AS context, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS us FROM events),
i AS (SELECT item, context, min(us) AS first_seen, max(us) % 86400000000 AS moment FROM s GROUP BY 1, 2),
c AS (SELECT DISTINCT context, day, day * 86400000000 AS us, 0 AS start, 43200000000 AS stop FROM s WHERE day % 2 = 0),
a AS (SELECT i.item, i.context, c.day, c.us FROM i JOIN c ON i.context = c.context AND i.moment BETWEEN c.start AND c.stop AND i.first_seen < c.us
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item = i.item AND s.context = i.context AND s.day = c.day))"""


def seen_items(spark, sf):
    at = micros(F.col("ts"))
    seen = table(spark, sf, "events").select(F.col("user_id").alias("item"), (F.col("user_id") % 5).alias("context"), F.floor(at / DAY).alias("capture"), at.alias("at"))
    items = seen.groupBy("item", "context").agg(F.min("at").alias("first_seen"), (F.max("at") % DAY).alias("moment"))
    covered = seen.select("context", "capture").distinct().where("capture % 2 = 0").select("context", "capture", (F.col("capture") * DAY).alias("at"), F.lit(0).cast("long").alias("start"), F.lit(DAY // 2).alias("stop"))
    return items, seen, covered


@query(f"WITH {SEEN} SELECT item, context, day::BIGINT AS capture FROM a")
def not_shown_absences(spark, sf):
    """Items a capture covered, without showing them, after they had been seen."""
    items, seen, covered = seen_items(spark, sf)
    return absences(items, seen, covered).select("item", "context", "capture")


@query(f"""WITH {SEEN}, l AS (SELECT item, context, max(us) AS last_seen FROM s WHERE day < 19740 GROUP BY 1, 2)
SELECT a.item, a.context, count(DISTINCT a.day)::BIGINT AS absences FROM a JOIN l ON l.item = a.item AND l.context = a.context AND a.us > l.last_seen GROUP BY 1, 2 HAVING count(DISTINCT a.day) >= 2""")
def possibly_cancelled_items(spark, sf):
    """Items absent from two captures or more since they were last seen."""
    items, seen, covered = seen_items(spark, sf)
    last = seen.where("capture < 19740").groupBy("item", "context").agg(F.max("at").alias("last_seen"))
    return possibly_cancelled(absences(items, seen, covered), last)


@query("""
SELECT o_orderkey AS item, array_to_string(list_filter([CASE WHEN o_totalprice < 50000 THEN 'low-confidence' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'guessed-time' END,
CASE WHEN o_custkey % 10 = 0 THEN 'open-duplicate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_orderstatus <> 'F'""")
def review_reasons(spark, sf):
    """Why an item waits for review, in a fixed order."""
    why = F.array(F.when(F.col("o_totalprice") < 50000, "low-confidence"), F.when(F.col("o_orderpriority") == "1-URGENT", "guessed-time"), F.when(F.col("o_custkey") % 10 == 0, "open-duplicate"))
    return table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("item"), F.array_join(F.array_compact(why), ",").alias("reasons"))
