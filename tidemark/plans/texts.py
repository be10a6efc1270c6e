"""Queries over text scalars and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table
from .registry import query

FOLD = "translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"
NORMALISE = "trim(regexp_replace(regexp_replace(" + FOLD.format("regexp_replace(trim({0}), '[….\\s]+$', '')") + ", '[''’`]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
FIRST_LINE = "split_part(text, chr(10), 1)"


def first_line(text="text"):
    return F.split_part(F.col(text), F.lit("\n"), F.lit(1))


@query(f"SELECT doc_id, {NORMALISE.format(FIRST_LINE)} AS title FROM documents")
def norm_titles(spark, sf):
    """Normalised titles: the documents' first lines."""
    return table(spark, sf, "documents").select("doc_id", X.normalise(first_line()).alias("title"))


@query(f"SELECT doc_id, {FOLD.format(FIRST_LINE)} AS folded, regexp_replace(lower({FIRST_LINE}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS compact FROM documents")
def fold_and_compact(spark, sf):
    line = first_line()
    return table(spark, sf, "documents").select("doc_id", X.fold(line).alias("folded"), X.compact(line).alias("compact"))


@query("""
SELECT doc_id, n::BIGINT AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE length(trim(line)) >= 2""")
def line_split(spark, sf):
    """Recognised lines: a document's lines by number."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.length(F.trim("line")) >= 2).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "line")


@query("""
WITH l AS (SELECT doc_id, n, line, length(line) * (40 + n % 7) AS area, count(*) OVER (PARTITION BY doc_id) AS c FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area DESC, n) AS k FROM l)
SELECT doc_id, count(*)::BIGINT AS kept, max(c)::BIGINT AS lines, sum(n)::BIGINT AS places FROM r WHERE k <= 600 GROUP BY doc_id""")
def prompt_line_cap(spark, sf):
    """The largest lines by area up to the 600 that a prompt shows, in their own order."""
    from pyspark.sql import Window

    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    lines = lines.withColumn("area", F.length("line") * (40 + F.col("n") % 7)).withColumn("c", F.count("*").over(Window.partitionBy("doc_id")))
    ranked = lines.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("area").desc(), "n")))
    return ranked.where("k <= 600").groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("c").alias("lines"), F.sum("n").alias("places"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(""" + FOLD.format("text") + """, '[\\p{L}\\p{N}]+'))) AS word FROM documents)
SELECT doc_id, count(*)::BIGINT AS keywords, min(word) AS first_word FROM w WHERE length(word) >= 4 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY doc_id""")
def title_keywords(spark, sf):
    """Distinct words of four letters or more that are not all digits."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("word"))
    words = words.where((F.length("word") >= 4) & ~F.col("word").rlike("^[0-9]+$"))
    return words.groupBy("doc_id").agg(F.count("*").alias("keywords"), F.min("word").alias("first_word"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host, len(list_distinct(regexp_extract_all(lower(html), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+')))::BIGINT AS addresses
FROM pages""")
def tags_domain(spark, sf):
    """Host and distinct e-mail addresses of pages."""
    found = F.regexp_extract_all(F.lower("html"), F.lit(r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"), 1)
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).alias("host"), F.size(F.array_distinct(found)).cast("long").alias("addresses"))


@query("""
WITH t AS (SELECT doc_id, 'at ' || (doc_id % 24) || ':' || lpad((doc_id % 60)::VARCHAR, 2, '0') || CASE WHEN doc_id % 3 = 0 THEN ' pm' ELSE '' END || ' ' || coalesce(text, '') AS x FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(lower(x), '\\b[0-9]{1,2}(?::[0-9]{2})? ?[ap]m\\b')) AS twelve, len(list_filter(regexp_extract_all(x, '\\b([0-9]{1,2}):[0-9]{2}\\b', 1), lambda h: h::INT > 12)) AS day FROM t)
SELECT doc_id, CASE WHEN twelve > day THEN '12h' WHEN day > twelve THEN '24h' ELSE 'unknown' END AS clock_style FROM c""")
def tags_clock_style(spark, sf):
    """Majority between am/pm times and times past noon on a 24-hour clock."""
    d = F.col("doc_id")
    said = F.concat(F.lit("at "), (d % 24).cast("string"), F.lit(":"), F.lpad((d % 60).cast("string"), 2, "0"), F.when(d % 3 == 0, " pm").otherwise(""), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf, "documents").select("doc_id", said.alias("x"))
    twelve = F.size(F.regexp_extract_all(F.lower("x"), F.lit(r"(\b[0-9]{1,2}(?::[0-9]{2})? ?[ap]m\b)"), 1))
    day = F.size(F.filter(F.regexp_extract_all("x", F.lit(r"\b([0-9]{1,2}):[0-9]{2}\b"), 1), lambda h: h.cast("int") > 12))
    return rows.select("doc_id", F.when(twelve > day, "12h").when(day > twelve, "24h").otherwise("unknown").alias("clock_style"))


@query("""
WITH t AS (SELECT event_id, 'UTC' || CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END || (event_id % 12) || ' or GMT +' || (event_id % 9) || ':30' AS x FROM events)
SELECT event_id, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(x, '(?:GMT|UTC) ?[+-][0-9]{1,2}(?::[0-9]{2})?'), lambda z: replace(z, ' ', '')))), 'string_agg', ',') AS zones FROM t""")
def tags_zone_labels(spark, sf):
    """Distinct zone labels with their spaces removed."""
    e = F.col("event_id")
    said = F.concat(F.lit("UTC"), F.when(e % 2 == 0, "+").otherwise("-"), (e % 12).cast("string"), F.lit(" or GMT +"), (e % 9).cast("string"), F.lit(":30"))
    found = F.transform(F.regexp_extract_all(said, F.lit(r"((?:GMT|UTC) ?[+-][0-9]{1,2}(?::[0-9]{2})?)"), 1), lambda z: F.replace(z, F.lit(" "), F.lit("")))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("zones"))


@query("""
WITH h(context, kind, value) AS (VALUES ('work', 'title', 'the'), ('work', 'keyword', 'tion'), ('home', 'domain', 'example.com'), ('home', 'keyword', 'der'), ('club', 'title', 'les')),
s AS (SELECT p.page_id, h.context, sum(CASE kind WHEN 'title' THEN 3 WHEN 'domain' THEN 2.5 ELSE 1 END)::DOUBLE AS score
  FROM pages p JOIN h ON contains(lower(CASE kind WHEN 'domain' THEN p.url ELSE p.html END), h.value) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, context) AS k, lead(score, 1, 0) OVER (PARTITION BY page_id ORDER BY score DESC, context) AS next FROM s)
SELECT page_id, CASE WHEN score >= 2 AND score - next >= 1 THEN context END AS context, score, next AS runner_up FROM r WHERE k = 1""")
def context_scores(spark, sf):
    """Hint points by context (a fixed handful of hints); a context needs two points and a lead of one."""
    from pyspark.sql import Window

    hints = spark.createDataFrame([("work", "title", "the"), ("work", "keyword", "tion"), ("home", "domain", "example.com"), ("home", "keyword", "der"), ("club", "title", "les")], "context string, kind string, value string")
    pages = table(spark, sf, "pages").select("page_id", F.lower("url").alias("url"), F.lower("html").alias("html"))
    held = F.when(F.col("kind") == "domain", F.col("url")).otherwise(F.col("html")).contains(F.col("value"))
    points = F.when(F.col("kind") == "title", 3.0).when(F.col("kind") == "domain", 2.5).otherwise(1.0)
    scored = pages.join(F.broadcast(hints), held).groupBy("page_id", "context").agg(F.sum(points).alias("score"))
    best = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "context")
    ranked = scored.withColumn("k", F.row_number().over(best)).withColumn("runner_up", F.lead("score", 1, 0.0).over(best)).where("k = 1")
    return ranked.select("page_id", F.when((F.col("score") >= 2) & (F.col("score") - F.col("runner_up") >= 1), F.col("context")).alias("context"), "score", "runner_up")


@query("SELECT event_id, json_extract_string(props, '$.' || list_sort(json_keys(props))[1]) AS first_value, len(json_keys(props))::BIGINT AS n_keys FROM events")
def props_json(spark, sf):
    """JSON columns: keys and a value."""
    keys = F.array_sort(F.json_object_keys("props"))
    held = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", held[F.element_at(keys, 1)].alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("""
SELECT conv_id, sha256(string_agg(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}]+', ' ', 'g'), '[\\p{Cf}\\p{Cc}]', '', 'g')), '|' ORDER BY turn, role)) AS entry_hash FROM conversations GROUP BY conv_id""")
def entry_hash(spark, sf):
    """A hash of what a reader sees of an entry."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", X.readable(F.coalesce("text", F.lit(""))).alias("t"))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "t")))
    return rows.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(said, lambda s: s["t"]), "|"), 256).alias("entry_hash"))
