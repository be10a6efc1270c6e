"""Queries over what models say of pictures, search documents, checks of evaluation, and rectangles of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import compact
from ..functions.times import micros
from ..operators import checks as C
from ..operators import reading as R
from ..operators import search as S
from ..operators import spatial as G
from ..sources.folders import spread
from ..sources.tables import table
from .registry import query


def _pick(column, *values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


@query("""
WITH a AS (SELECT event_id, ['appointment', 'task', 'party', 'deadline'][event_id % 4 + 1] AS kind, CASE WHEN event_id % 5 > 0 THEN 'T' || user_id ELSE ' ' END AS title, ['1', '22', '1.5', 'x'][event_id % 7 % 4 + 1] AS line FROM events)
SELECT event_id, CASE WHEN kind <> 'party' AND trim(title) <> '' AND line IN ('1', '22') THEN title END AS title FROM a""")
def draft_validation(spark, sf):
    """Findings that are worth keeping: a known kind, a title, and whole numbers as citations."""
    e = F.col("event_id")
    title = F.when(e % 5 > 0, F.concat(F.lit("T"), F.col("user_id").cast("string"))).otherwise(" ")
    line = F.element_at(F.array(*map(F.lit, ("1", "22", "1.5", '"x"'))), (e % 7 % 4 + 1).cast("int"))
    answer = F.format_string('{"kind": "%s", "title": "%s", "lines": [%s]}', _pick(e, "appointment", "task", "party", "deadline"), title, line)
    return table(spark, sf, "events").select("event_id", R.draft(answer)["title"].alias("title"))


SCHEMA = {
    "type": "object", "required": ["kind", "lines"], "additionalProperties": False,
    "properties": {"kind": {"type": "string", "enum": ["a", "b"], "minLength": 1}, "lines": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "integer"}}, "sure": {"type": "boolean"}},
}


@query("""
SELECT event_id, ['$.lines: required', NULL, '$.kind: enum', '$.lines: minItems', '$.lines[1]: items', '$.more: additionalProperties', '$: type', '$.kind: type', '$.lines: maxItems'][event_id % 9 + 1] AS problem FROM events""")
def schema_validation(spark, sf):
    """The first place where an answer breaks its JSON schema."""
    texts = ('{"kind": "a"}', '{"kind": "b", "lines": [1, 2], "sure": true}', '{"kind": "c", "lines": [1]}', '{"kind": "a", "lines": []}', '{"kind": "a", "lines": [1, "x"]}',
             '{"kind": "a", "lines": [1], "more": 1}', "[1]", '{"kind": 5, "lines": [1]}', '{"kind": "a", "lines": [1, 2, 3, 4]}')
    answer = F.parse_json(_pick(F.col("event_id"), *texts))
    return table(spark, sf, "events").select("event_id", answer.alias("v")).select("event_id", R.schema_problem(F.col("v"), SCHEMA).alias("problem"))


@query("""
WITH c AS (SELECT event_id, ['email', 'chat', 'calendar_day', 'calendar_month', 'poem'][event_id % 5 + 1] AS kind, (event_id % 10) / 10.0 AS confidence, event_id % 6 AS headers, event_id % 8 AS cells, value FROM events),
r AS (SELECT *, CASE WHEN kind <> 'poem' AND confidence >= 0.5 THEN kind ELSE 'other' END AS sure FROM c)
SELECT event_id, sure, CASE WHEN headers >= 3 AND (sure = 'calendar_day' OR sure = 'calendar_month' AND (cells = 0 OR value > 1.5 * 20)) THEN 'calendar_week' ELSE sure END AS corrected FROM r""")
def classification(spark, sf):
    """Screen kinds that are sure, and corrected by the day headers seen."""
    e = F.col("event_id")
    sure = R.resolved_kind(_pick(e, "email", "chat", "calendar_day", "calendar_month", "poem"), (e % 10) / 10.0)
    rows = table(spark, sf, "events").select("event_id", "value", sure.alias("sure"))
    return rows.select("event_id", "sure", R.corrected_kind(F.col("sure"), e % 6, F.col("value"), e % 8, F.lit(20.0)).alias("corrected"))


@query("""
WITH t AS (SELECT user_id % 40 AS capture, event_type AS name, ['Mail', 'unknown', 'N/A', 'Chat', ' none ', ''][event_id % 6 + 1] AS value, event_id AS n, (event_id % 10) / 10.0 AS confidence FROM events)
SELECT capture, name, value, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY capture, name, value ORDER BY n) AS k FROM t WHERE lower(trim(value)) NOT IN ('', 'unknown', 'none', 'n/a', 'na')) WHERE k = 1""")
def classification_tags(spark, sf):
    """Tags that say something, each name and value once."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select((F.col("user_id") % 40).alias("capture"), F.col("event_type").alias("name"), _pick(e, "Mail", "unknown", "N/A", "Chat", " none ", "").alias("value"), e.alias("n"), ((e % 10) / 10.0).alias("confidence"))
    return R.tags_of(rows, "capture")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN c WHEN CASE k WHEN 'application' THEN v <> 'Mail' AND NOT (v = 'Teams' AND event_id % 2 = 0) WHEN 'remote_session' THEN event_id % 3 > 0 WHEN 'platform_look' THEN v <> 'macOS' ELSE FALSE END THEN least(c, 0.4) ELSE c END AS confidence
FROM (SELECT event_id, ['application', 'remote_session', 'platform_look', 'theme'][event_id % 4 + 1] AS k, ['Mail', 'Teams', 'macOS'][event_id % 7 % 3 + 1] AS v, (event_id % 10) / 10.0 AS c FROM events)""")
def doubted_tags(spark, sf):
    """Confidence of tags that the windows of a capture contradict."""
    e = F.col("event_id")
    value = F.element_at(F.array(F.lit("Mail"), F.lit("Teams"), F.lit("macOS")), (e % 7 % 3 + 1).cast("int"))
    apps = F.when(e % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Mail"), F.lit("com.apple.mail")))
    lines = F.when(e % 2 == 0, F.array(F.lit("Call in Teams"))).otherwise(F.array(F.lit("nothing")))
    return table(spark, sf, "events").select("event_id", R.doubted(_pick(e, "application", "remote_session", "platform_look", "theme"), value, (e % 10) / 10.0, apps, e % 3 == 0, lines).alias("confidence"))


@query("""
SELECT c_custkey AS context, CASE WHEN k = 0 THEN 'Europe/Madrid' WHEN k = 1 THEN 'Asia/Tokyo' ELSE 'Europe/Madrid' END AS zone, ['machine', 'context', 'invalid-context-zone'][k + 1] AS source FROM (SELECT *, c_custkey % 3 AS k FROM customer)""")
def context_zones(spark, sf):
    """The zone that a context gives its dates."""
    k = F.col("c_custkey") % 3
    zone = R.zone_of(F.when(k == 1, "Asia/Tokyo").when(k == 2, "Mars/Base"), F.lit("Europe/Madrid"), F.array(F.lit("Asia/Tokyo"), F.lit("Europe/Madrid"), F.lit("UTC")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("context"), zone.alias("z")).select("context", "z.zone", "z.source")


@query("""
WITH d AS (SELECT l_orderkey AS image, l_linenumber AS n, 'title ' || (l_linenumber % 2) AS title, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS start, CASE WHEN l_linenumber > 2 THEN l_linestatus END AS place, l_linenumber // 4 AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag) AS u FROM lineitem) WHERE u = 1),
f AS (SELECT *, min(n) OVER (PARTITION BY image, title, line) AS f FROM d)
SELECT image, f::INT AS n, min_by(title, n) AS title, min_by(start, n) FILTER (start IS NOT NULL) AS start, min_by(place, n) FILTER (place IS NOT NULL) AS place FROM f GROUP BY image, title, f""")
def merge_repeats(spark, sf):
    """Findings that a model listed twice, as one with what either had."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"))
    n = F.col("l_linenumber")
    rows = spread(table(spark, sf, "lineitem"), "l_orderkey").withColumn("u", first).where("u = 1").select(
        F.col("l_orderkey").alias("image"), n.alias("n"), F.concat(F.lit("title "), (n % 2).cast("string")).alias("title"), F.when(n % 3 > 0, F.col("l_quantity")).alias("start"),
        F.lit(None).cast("double").alias("end"), F.lit(None).cast("double").alias("due"), F.when(n > 2, F.col("l_linestatus")).alias("place"), F.array(F.floor(n / 4)).alias("lines"),
    )
    return R.merged_repeats(rows).select("image", F.col("n").cast("int").alias("n"), "title", "start", "place")


@query("SELECT event_id, [NULL, 'unknown window', 'window named twice', 'window left out'][event_id % 4 + 1] AS problem FROM events")
def windows_answers(spark, sf):
    """Answers on windows that do not name exactly the windows asked about."""
    named = F.from_json(_pick(F.col("event_id"), '["b","a"]', '["a","b","c"]', '["a","b","a"]', '["a"]'), "array<string>")
    return table(spark, sf, "events").select("event_id", R.windows_problem(F.array(F.lit("a"), F.lit("b")), named).alias("problem"))


@query("""
WITH w AS (SELECT l_orderkey AS image, l_linenumber AS stack, l_returnflag = 'R' OR l_linenumber = 3 AS fits, ['chat', 'other', 'email', NULL][l_partkey % 4 + 1] AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag) AS u FROM lineitem) WHERE u = 1)
SELECT image, coalesce(min_by(kind, stack) FILTER (fits AND kind <> 'other'), 'other') AS kind FROM w GROUP BY 1""")
def classification_from_windows(spark, sf):
    """A capture's kind: that of its frontmost relevant window; a chosen window is always relevant."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"))
    kind = F.when(F.col("l_partkey") % 4 == 0, "chat").when(F.col("l_partkey") % 4 == 1, "other").when(F.col("l_partkey") % 4 == 2, "email")
    rows = spread(table(spark, sf, "lineitem"), "l_orderkey").withColumn("u", first).where("u = 1").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("stack"), (F.col("l_returnflag") == "R").alias("relevant"), (F.col("l_linenumber") == 3).alias("chosen"), kind.alias("kind"))
    return R.kind_from_windows(rows)


@query("SELECT event_id, ['Room 4 until 11:30', '11:30', 'at 1 1:3 0 pm', 'noon'][event_id % 4 + 1] IN ('Room 4 until 11:30', 'at 1 1:3 0 pm') AS shown FROM events")
def ends_shown(spark, sf):
    """Whether the end of a finding stands in its cited lines, and not only on a clock."""
    line = _pick(F.col("event_id"), "Room 4 until 11:30", "11:30", "at 1 1:3 0 pm", "noon")
    return table(spark, sf, "events").select("event_id", R.end_is_shown(F.lit("11:30"), F.array(line)).alias("shown"))


@query("""
WITH f AS (SELECT event_id, ['appointment', 'task', 'deadline'][event_id % 3 + 1] AS kind, epoch(ts)::BIGINT AS start, epoch(ts)::BIGINT + (event_id % 9 - 2) * 1800 AS stop, event_id % 2 = 0 AS shown, CASE WHEN event_id % 4 = 0 THEN 5 END AS due FROM events)
SELECT event_id, CASE WHEN kind = 'appointment' THEN start END AS start, CASE WHEN kind = 'appointment' THEN CASE WHEN shown AND stop > start THEN stop ELSE least(start + 3600, (start // 86400 + 1) * 86400) END END AS "end",
 CASE WHEN kind <> 'appointment' THEN coalesce(due, start) END AS due FROM f""")
def assembled_findings(spark, sf):
    """Spans and due times of findings: an end only if shown, else an hour within the day."""
    e, start = F.col("event_id"), F.rint(micros(F.col("ts")) / 1_000_000).cast("long")
    midnight = (F.floor(start / 86400) + 1) * 86400
    made = R.assembled(start, start + (e % 9 - 2) * 1800, F.when(e % 4 == 0, F.lit(5).cast("long")), _pick(e, "appointment", "task", "deadline"), e % 2 == 0, midnight)
    return table(spark, sf, "events").select("event_id", made.alias("m")).select("event_id", "m.*")


@query("""
SELECT event_id, ['es,en,fr', 'en,es,fr', 'fr,en,es', 'en,es,fr'][event_id % 4 + 1] AS locales, CASE WHEN event_id % 3 = 0 THEN 'appointment' ELSE 'task' END AS kind, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 5 END AS month FROM events""")
def small_readings(spark, sf):
    """Locales with the detected language first, kinds of findings in calendar views, months by shift."""
    e = F.col("event_id")
    locales = R.locale_order(F.array(F.lit("en"), F.lit("es"), F.lit("fr")), _pick(e, "es", "en", "fr", "xx"))
    kind = R.as_appointment(F.lit("task"), F.when(e % 3 == 0, "calendar_week").otherwise("chat"))
    month = F.month(D.month_index(F.lit("2026-01-31").cast("date"), F.when(e % 3 == 0, 3).otherwise(4)))
    return table(spark, sf, "events").select("event_id", F.array_join(locales, ",").alias("locales"), kind.alias("kind"), month.alias("month"))


@query("""
WITH c AS (SELECT event_id, user_id AS finding, event_id AS item, value AS combined, event_id % 7 AS seen, ['uncertain:', 'new:different', 'uncertain:'][event_id % 3 + 1] AS decision, user_id % 4 = 0 AS undated FROM events)
SELECT finding, item, round(least(exp(-0.1 - item % 3) / (exp(-0.1 - item % 3) + exp(-1.0)), exp(-0.2) / (exp(-0.2) + exp(-0.5 - item % 2))), 6) AS yes
FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY combined DESC, seen DESC, item) AS n FROM c WHERE decision = 'uncertain:' AND NOT undated) WHERE n <= 2""")
def judged_pairs(spark, sf):
    """Candidates that a judge is asked about, two for each finding at most, and its probability from both orders."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("finding"), e.alias("item"), F.col("value").alias("combined"), (e % 7).alias("seen"), _pick(e, "uncertain:", "new:different", "uncertain:").alias("decision"), (F.col("user_id") % 4 == 0).alias("undated"))
    item = F.col("item")
    yes = R.yes_probability(-0.1 - item % 3, F.lit(-1.0), F.lit(-0.2), -0.5 - item % 2)
    return R.judged_candidates(rows).select("finding", "item", F.round(yes, 6).alias("yes"))


@query("""
WITH p AS (SELECT o_orderkey AS pair, epoch(o_orderdate)::BIGINT AS t, o_orderkey AS k, o_custkey AS c FROM orders)
SELECT pair, (2 + CASE WHEN k % 3 < 2 THEN 2 ELSE 0 END + (k % 4 = 0)::INT + (k % 5 > 0)::INT + (k % 6 > 0)::INT)::BIGINT AS compared,
 ((k % 7 > 0)::INT + (k % 2 = 0)::INT + CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END + (k % 4 = 0 AND k % 8 = 0)::INT + (k % 5 > 0 AND k % 5 < 3)::INT + (k % 6 > 0 AND k % 6 < 4)::INT)::BIGINT AS equal FROM p""")
def field_compare(spark, sf):
    """Compared and equal fields of matched findings."""
    k, t = F.col("o_orderkey"), F.floor(micros(F.col("o_orderdate")) / 1_000_000)
    none = F.lit(None).cast("long")
    people = lambda test, *names: F.when(test, F.array(*map(F.lit, names)))

    def side(start, end, inferred, all_day, who, window, place):
        return F.struct(start.alias("start"), end.alias("end"), none.alias("due"), none.alias("remind"), inferred.alias("inferred"), all_day.alias("all_day"), who.alias("people"), window.alias("window"), place.alias("place"))

    want = side(t, F.when(k % 3 < 2, t + 60), F.when(k % 2 == 0, F.array(F.lit("start"))).otherwise(F.array().cast("array<string>")), F.when(k % 4 == 0, F.lit(True)),
                people(k % 5 > 0, "Ann", "BO"), F.when(k % 6 > 0, "w"), F.lit(None).cast("string"))
    got = side(F.when(k % 7 > 0, t).otherwise(t + 60), F.when(k % 3 == 0, t + 60), F.array(F.lit("start")), k % 8 == 0, people((k % 5 > 0) & (k % 5 < 3), "bo", "ann"), F.when(k % 6 < 4, "w").otherwise("v"), F.lit(""))
    rows = table(spark, sf, "orders").select(k.alias("pair"), C.field_problems(want, got).alias("x"))
    return rows.select("pair", F.size("x").cast("long").alias("compared"), F.size(F.filter("x", lambda n: n["same"])).cast("long").alias("equal"))


@query("""
WITH l AS (SELECT doc_id AS "case", generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
a AS (SELECT "case", n, regexp_replace(regexp_replace(text, '[‐-―−]', '-', 'g'), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS t FROM l), b AS (SELECT "case", CASE WHEN n % 3 = 0 THEN t || 'x' ELSE t END AS u FROM a WHERE n % 2 = 1)
SELECT "case", count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b."case" = a."case" AND (u = t OR length(t) >= 4 AND contains(u, t))))::BIGINT AS exact, count(*)::BIGINT AS expected FROM a GROUP BY 1""")
def line_score(spark, sf):
    """How many expected lines were read: alone, or within a longer line."""
    lines = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("case"), F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n") + 1)
    lines = lines.withColumn("box", F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"))
    got = lines.where("n % 2 = 1").withColumn("text", F.when(F.col("n") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return C.line_scores(lines, got).select("case", "exact", "expected")


@query("""
WITH d AS (SELECT c.conv_id, c.turn, regexp_replace(lower(coalesce(c.text, '')), '[^\\p{L}\\p{N}]', '', 'g') AS t, coalesce(n.text, '') AS cited, regexp_replace(lower(coalesce(n.text, '')), '[^\\p{L}\\p{N}]', '', 'g') AS u
 FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)
SELECT conv_id, turn, cited <> '' AND t <> '' AND NOT contains(u, t) AND NOT contains(t, u) AS disagrees FROM d""")
def disagreements(spark, sf):
    """Turns whose words are not in the next turn, nor the other way round."""
    c = table(spark, sf, "conversations")
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cited"))
    return c.join(other, ["conv_id", "turn"], "left").select("conv_id", "turn", C.disagrees(F.coalesce("text", F.lit("")), F.coalesce("cited", F.lit(""))).alias("disagrees"))


@query("""
WITH t AS (SELECT p_partkey % 50 AS "case", p_partkey AS id, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS c FROM part),
p AS (SELECT f."case", f.id AS found, e.id AS expected, f.c AS x, e.c AS y FROM t f JOIN t e ON e."case" = f."case" AND e.id % 2 = 0 WHERE f.id % 4 = 1),
s AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN least(length(x), length(y)) >= 3 AND (contains(x, y) OR contains(y, x)) THEN greatest(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 0.8 + 0.2 * least(length(x), length(y))::DOUBLE / greatest(length(x), length(y)) * 0.99)
 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END AS score FROM p)
SELECT "case", found, max_by(expected, (score, -expected)) AS expected FROM s GROUP BY 1, 2""")
def closest_expected(spark, sf):
    """The expected title that is most like each one found."""
    t = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("case"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return C.closest(t.where("id % 4 = 1"), t.where("id % 2 = 0"))


@query("""
WITH n AS (SELECT avg(quality) AS precision, avg(toxic) AS wrong FROM labels) SELECT 'precision' AS gate, precision::DOUBLE AS value, precision >= 0.5 AS passed FROM n UNION ALL SELECT 'wrong', wrong, wrong <= 0.01 FROM n""")
def evaluation_gates(spark, sf):
    """Numbers against their limits."""
    return C.gates(table(spark, sf, "labels").agg(F.avg("quality").alias("precision"), F.avg("toxic").alias("wrong")), {"precision": 0.5}, {"wrong": 0.01})


@query("""
WITH a AS (SELECT DISTINCT o_custkey % 20 AS "case", o_custkey AS item FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey % 20 AS "case", o_custkey AS item FROM orders WHERE o_orderkey % 3 = 0)
SELECT "case", count(a.item)::BIGINT AS before, count(b.item)::BIGINT AS after, count(*) FILTER (a.item IS NULL)::BIGINT AS fresh FROM a FULL OUTER JOIN b USING ("case", item) GROUP BY 1""")
def reanalysis_check(spark, sf):
    """Items that a second pass over the same pictures made."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("case"), F.col("o_custkey").alias("item"), "o_orderkey")
    return C.reanalysed(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"))


@query("""
WITH r AS (SELECT o_custkey % 100 AS "case", o_orderkey % 2 AS k, count(*) AS merged, count(*) FILTER (o_orderstatus = 'P') AS wrong, count(DISTINCT o_custkey) AS items FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM r WHERE k = 0), b AS (SELECT * FROM r WHERE k = 1)
SELECT "case", (b.merged - a.merged)::BIGINT AS merged, (b.wrong - a.wrong)::BIGINT AS wrong, (b.items - a.items)::BIGINT AS items FROM a FULL OUTER JOIN b USING ("case")
WHERE coalesce(abs(b.merged - a.merged) + abs(b.wrong - a.wrong) + abs(b.items - a.items), 1) > 0""")
def sequence_compare(spark, sf):
    """Cases that two reports over sequences see differently."""
    o = table(spark, sf, "orders").withColumn("case", F.col("o_custkey") % 100)
    side = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("case").agg(F.count("*").alias("merged"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("wrong"), F.countDistinct("o_custkey").alias("items"))
    return C.compared_sequences(side(0), side(1))


@query("""
WITH s AS (SELECT event_id AS image, user_id AS item, epoch_us(ts) AS at_ FROM events WHERE event_id % 3 = 0), a AS (SELECT event_id AS image, user_id AS item, epoch_us(ts) AS at_ FROM events WHERE event_id % 3 > 0 AND event_id % 12 <> 7),
l AS (SELECT item, max(at_) AS last_seen FROM s GROUP BY 1)
SELECT item, last_seen, count(DISTINCT image)::BIGINT AS absences, max_by(image, (at_, image)) AS newest FROM a JOIN l USING (item) WHERE at_ > last_seen GROUP BY 1, 2""")
def cancel_suspicion(spark, sf):
    """When items were last seen, and the pictures since that do not show them; a re-read only takes absences away."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("image"), F.col("user_id").alias("item"), micros(F.col("ts")).alias("at"))
    reread = e.where("image % 12 = 7")
    absent = C.contradicted(e.where("image % 3 > 0"), reread, reread.select("image"))
    out = C.suspicion(absent, e.where("image % 3 = 0"))
    return out.select("item", "last_seen", F.size("absences").cast("long").alias("absences"), F.col("absences")[0].alias("newest"))


@query("""
SELECT n_name AS name, min_by('z' || (c_custkey % 7), c_custkey) AS zone FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def distinct_contexts(spark, sf):
    """Contexts of cases by name; the first wins."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    rows = table(spark, sf, "customer").join(F.broadcast(n), "c_nationkey").select(F.col("c_custkey").alias("case"), "name", F.concat(F.lit("z"), (F.col("c_custkey") % 7).cast("string")).alias("zone"))
    return C.distinct_contexts(rows)


@query("""
WITH i AS (SELECT p_partkey AS item, p_name AS title, p_size % 9 = 0 AS gone, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS notes, p_brand AS place FROM part),
a AS (SELECT DISTINCT l_partkey AS item, 'alias ' || (l_linenumber % 3) AS s FROM lineitem WHERE l_linenumber % 3 > 0 UNION SELECT p_partkey, p_name FROM part),
j AS (SELECT a.item, string_agg(s, ' ' ORDER BY s) AS aliases FROM a JOIN i ON i.item = a.item AND s <> title GROUP BY 1)
SELECT i.item, title, coalesce(aliases, '') AS aliases, notes, place, '' AS people FROM i LEFT JOIN j USING (item) WHERE NOT gone""")
def item_documents(spark, sf):
    """Items as documents to search."""
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 9 == 0, "merged").otherwise("active").alias("status"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("notes"), F.col("p_brand").alias("place"), F.lit(None).cast("array<string>").alias("people"),
    )
    n = F.col("l_linenumber") % 3
    a = table(spark, sf, "lineitem").where(n > 0).select(F.col("l_partkey").alias("item"), F.concat(F.lit("alias "), n.cast("string")).alias("spelling")).distinct()
    return S.item_documents(p, a.unionByName(p.select("item", F.col("title").alias("spelling"))))


@query("""
WITH l AS (SELECT conv_id AS image, turn AS n, text FROM conversations)
SELECT image, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY n, text)) AS digest FROM l GROUP BY 1 HAVING string_agg(coalesce(text, ''), chr(10) ORDER BY n, text) <> ''""")
def capture_documents(spark, sf):
    """Pictures' lines as documents to search."""
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("image"), F.col("turn").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    return S.capture_documents(lines).select("image", F.md5("text").alias("digest"))


@query("""
SELECT o_orderkey AS item FROM (SELECT *, ['appointment', 'task', 'deadline', 'reminder'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_custkey % 3 > 0 THEN 'c' || (o_custkey % 3) END AS context FROM orders)
WHERE o_orderstatus IN ('F', 'O') AND kind IN ('task', 'deadline') AND context IS NULL AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1996-06-01'""")
def search_filters(spark, sf):
    """Items that a search for tasks without a context, within dates, looks at."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        k.alias("item"), _pick(k, "appointment", "task", "deadline", "reminder").alias("kind"), F.when(c % 3 > 0, F.concat(F.lit("c"), (c % 3).cast("string"))).alias("context"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("merged").alias("status"), F.lit("todo").alias("family"),
        F.lit(None).cast("timestamp_ntz").alias("start"), F.col("o_orderdate").cast("timestamp_ntz").alias("due"),
    )
    dates = tuple(F.lit(x).cast("timestamp_ntz") for x in ("1993-01-01 00:00:00", "1996-06-01 00:00:00"))
    return rows.where(S.item_filter(("tasks", "captures"), None, dates, dismissed=True)).select("item")


@query("""
WITH l AS (SELECT doc_id AS image, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM documents),
m AS (SELECT image, n, list_filter(regexp_extract_all(translate(lower(line), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[\\p{L}\\p{N}]+'), lambda t: t = 'the' OR starts_with(t, 'her')) AS k FROM l)
SELECT image, n, array_to_string(k, ',') AS marks FROM m WHERE len(k) > 0""")
def viewer_marks(spark, sf):
    """Lines that match a query, with the words that do."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n") + 1)
    return S.viewer(lines, S.parse("the her")).where(F.size("marks") > 0).select("image", "n", F.array_join("marks", ",").alias("marks"))


@query("""
SELECT p_partkey AS item, (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1)::INT AS place, p_name AS title FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def restricted_list(spark, sf):
    """A list of items cut to a search's best hits, in their order."""
    p = table(spark, sf, "part")
    return S.restricted(p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title")), p.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("score")), "item", 100).select("item", "place", "title")


@query("""
WITH w AS (SELECT l_orderkey AS image, l_partkey % 1000 AS "window", l_linenumber AS stack, l_partkey % 300 - 50 AS x, l_suppkey % 90 - 20 AS y, (l_quantity * 10)::BIGINT AS w, (l_partkey % 150)::BIGINT AS h FROM lineitem),
c AS (SELECT image, "window", stack, greatest(x, 0) AS x, greatest(y, 0) AS y, least(x + w, 200) - greatest(x, 0) AS w, least(y + h, 100) - greatest(y, 0) AS h FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, stack, "window") AS n FROM c WHERE w > 0 AND h > 0)
SELECT image, "window", stack, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h FROM r WHERE n <= 3""")
def window_selection(spark, sf):
    """A picture's largest windows, clipped to it."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 1000).alias("window"), F.col("l_linenumber").alias("stack"), F.lit(200).alias("width"), F.lit(100).alias("height"),
        F.struct((F.col("l_partkey") % 300 - 50).alias("x"), (F.col("l_suppkey") % 90 - 20).alias("y"), (F.col("l_quantity") * 10).cast("long").alias("w"), (F.col("l_partkey") % 150).alias("h")).alias("box"),
    )
    out = G.selected_windows(rows, 3)
    return out.select("image", "window", "stack", *[F.col(f"box.{c}").cast("long").alias(c) for c in "xywh"])


@query("""
WITH e AS (SELECT event_id, event_id % 40 * 10 - 50 AS x, event_id % 30 * 10 AS y FROM events), d AS (SELECT unnest([0, 1]) AS display)
SELECT event_id, display::INT AS display, (greatest(x, display * 200) - display * 200)::BIGINT AS x, y::BIGINT AS y, (least(x + 120, display * 200 + 200) - greatest(x, display * 200))::BIGINT AS w, (least(y + 80, 250) - y)::BIGINT AS h FROM e, d
WHERE least(x + 120, display * 200 + 200) > greatest(x, display * 200) AND least(y + 80, 250) > y""")
def outline_segments(spark, sf):
    """The parts of frames on two displays side by side."""
    e = F.col("event_id")
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    frame = box(e % 40 * 10 - 50, e % 30 * 10, F.lit(120), F.lit(80))
    each = F.explode(F.array(F.lit(0), F.lit(1))).alias("display")
    screen = F.from_json(F.format_string('{"x": %d, "y": 0, "w": 200, "h": 250}', F.col("display") * 200), "x long, y long, w long, h long")
    rows = table(spark, sf, "events").select("event_id", each).withColumn("frame", frame).withColumn("screen", screen)
    out = rows.select("event_id", "display", G.outline(F.col("frame"), F.col("screen")).alias("b")).where("b is not null")
    return out.select("event_id", "display", *[F.col(f"b.{c}").cast("long").alias(c) for c in "xywh"])


@query("""
WITH b AS (SELECT event_id, (event_id % 10) / 16.0 AS x, (event_id % 7) / 16.0 AS y, (event_id % 5 + 1) / 32.0 AS w, (event_id % 3) / 32.0 AS h FROM events),
p AS (SELECT event_id, greatest(0, floor(x * 1000 + 1e-6)) AS l, least(1000, ceil((x + w) * 1000 - 1e-6)) AS r, greatest(0, floor((1 - (y + h)) * 700 + 1e-6)) AS t, least(700, ceil((1 - y) * 700 - 1e-6)) AS b FROM b)
SELECT event_id, l::BIGINT AS x, t::BIGINT AS y, greatest(1, greatest(l, r) - l)::BIGINT AS w, greatest(1, greatest(t, b) - t)::BIGINT AS h FROM p""")
def pixel_boxes(spark, sf):
    """Boxes in fractions from the bottom left as whole pixels from the top left."""
    e = F.col("event_id")
    box = F.struct((e % 10 / 16.0).alias("x"), (e % 7 / 16.0).alias("y"), ((e % 5 + 1) / 32.0).alias("w"), (e % 3 / 32.0).alias("h"))
    out = table(spark, sf, "events").select("event_id", G.pixel_box(box, F.lit(1000), F.lit(700)).alias("b"))
    return out.select("event_id", "b.x", "b.y", F.col("b.w").cast("long").alias("w"), F.col("b.h").cast("long").alias("h"))


@query("""
SELECT event_id, ['Dock', 'Mail', 'Window Server', NULL][event_id % 4 + 1] = 'Window Server' IS TRUE OR event_id % 3 = 0 AS system FROM events""")
def system_surfaces(spark, sf):
    """Windows that are the system's own."""
    e = F.col("event_id")
    app = F.when(e % 4 == 0, "Dock").when(e % 4 == 1, "Mail").when(e % 4 == 2, "Window Server")
    return table(spark, sf, "events").select("event_id", R.is_system(app, F.when(e % 3 == 0, "com.apple.Dock").otherwise("com.example")).alias("system"))
