"""Queries over record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise
from ..functions.times import DAY, MINUTE, micros
from ..operators import linkage as L
from ..sources.tables import table
from .registry import query
from .texts import FIRST_LINE, NORMALISE, first_line

SIMILARITY = """CASE WHEN x.title = '' OR y.title = '' THEN 0.0 WHEN length(x.title) >= 8 AND starts_with(y.title, x.title) OR length(y.title) >= 8 AND starts_with(x.title, y.title) THEN 0.95
 ELSE greatest(1 - levenshtein(x.title, y.title)::DOUBLE / greatest(length(x.title), length(y.title)),
 2.0 * len(list_intersect(string_split(x.title, ' '), string_split(y.title, ' '))) / (len(list_distinct(string_split(x.title, ' '))) + len(list_distinct(string_split(y.title, ' '))))) END"""
#: DuckDB compares bytes: letters of several bytes that folding leaves are written as one sign each.
ONE_BYTE = "translate({0}, 'ßœæøłđ', '~^@#$&')"
TITLES = f"(SELECT lang, source, day, title, min(doc_id) AS name FROM (SELECT doc_id, lang, source, doc_id // 200 AS day, {ONE_BYTE.format(NORMALISE.format(FIRST_LINE))} AS title FROM documents) GROUP BY 1, 2, 3, 4)"


@query(f"""
WITH t AS {TITLES}, p AS (SELECT x.name AS a, y.name AS b, ({SIMILARITY})::DOUBLE AS s FROM t x JOIN t y ON x.lang IS NOT DISTINCT FROM y.lang AND x.source IS NOT DISTINCT FROM y.source AND x.day = y.day AND x.name < y.name)
SELECT a, b, round(s, 6) AS score, CASE WHEN s >= 0.9 THEN 'merge:undated-text' WHEN s < 0.7 THEN 'new:undated-low-text' ELSE 'uncertain:' END AS decision FROM p""")
def title_pairs_scored(spark, sf):
    """Blocking by family, context and day, title similarity and decision for titles without dates.

    Languages stand for families, sources for contexts, and 200 ids for a day; every document's first line is a title.
    """
    day = F.floor(F.col("doc_id") / 200).alias("day")
    titles = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), "lang", "source", day, normalise(first_line()).alias("title")).where("title is not null")
    pairs = L.title_pairs(titles, ["lang", "source", "day"])
    return pairs.select("a", "b", F.round("score", 6).alias("score"), L.decide(F.col("score"), F.lit(1.0), F.lit(None).cast("double"), F.lit(True)).alias("decision"))


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT a, b, cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM c) WHERE k <= 2""")
def embed_cosine_topk(spark, sf):
    """The two known titles of the same event nearest in meaning, for every title whose id 100 divides."""
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return L.nearest(e, e.where("b % 100 = 0").withColumnRenamed("b", "a"), "label", 2)


@query("""
SELECT event_id, CASE WHEN u AND t >= 0.9 THEN 'merge:undated-text' WHEN u AND t < 0.7 THEN 'new:undated-low-text' WHEN u THEN 'uncertain:' WHEN t >= 0.9 AND m >= 0.5 THEN 'merge:text-time'
WHEN m >= 0.8 THEN 'uncertain:' WHEN t < 0.5 AND (c IS NULL OR c < 0.88) THEN 'new:different' ELSE 'uncertain:' END AS decision,
CASE WHEN c IS NULL THEN 'new:judge-unavailable' WHEN c >= 0.95 THEN 'merge:rerank-yes' ELSE 'new:rerank-no' END AS judged
FROM (SELECT event_id, (event_id % 11) / 10.0 AS t, (event_id % 6) / 5.0 AS m, CASE WHEN event_id % 3 > 0 THEN 0.8 + (event_id % 20) / 100.0 END AS c, event_id % 5 = 0 AS u FROM events)""")
def match_decisions(spark, sf):
    """The decision table over a spread of scores."""
    e = F.col("event_id")
    d = lambda c: c.cast("decimal(10,4)")
    rows = table(spark, sf, "events").select("event_id", d((e % 11) / 10).alias("t"), d((e % 6) / 5).alias("m"), F.when(e % 3 > 0, d(F.lit(0.8)) + d((e % 20) / 100)).alias("c"), (e % 5 == 0).alias("u"))
    return rows.select("event_id", L.decide(F.col("t").cast("double"), F.col("m").cast("double"), F.col("c").cast("double"), F.col("u")).alias("decision"), L.decide_after_rerank(F.col("c").cast("double")).alias("judged"))


@query("""
WITH f AS (SELECT event_id, user_id % 20 AS context, epoch_us(ts) // 86400000000 AS day, event_type AS title, event_id AS seq, epoch_us(ts) - epoch_us(ts) % 3600000000 AS start FROM events)
SELECT event_id AS finding, min(event_id) OVER (PARTITION BY context, day, title, start)::BIGINT AS item FROM f""")
def sequential_assignment(spark, sf):
    """Findings assigned to items in order; titles and whole hours here make the outcome expressible in SQL."""
    at = micros(F.col("ts"))
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("context"), F.floor(at / DAY).alias("day"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), F.col("event_id").alias("finding"),
        F.col("event_type").alias("title"), (at - at % (60 * MINUTE)).alias("start"), F.lit(False).alias("all_day"),
    )
    return L.assign(rows, ["context", "day"])


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 40 AS context, o_orderdate::DATE AS day FROM orders)
SELECT o.o_orderkey AS finding, count(*)::BIGINT AS candidates FROM o JOIN o i ON i.context = o.context AND i.day BETWEEN o.day - 1 AND o.day + 1 AND i.o_orderkey < o.o_orderkey GROUP BY 1""")
def blocking_join(spark, sf):
    """Candidates of a to-do: same context, the day before, of or after."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("context"), F.col("o_orderdate").cast("date").alias("day"))
    keyed = o.withColumn("key", F.explode(F.array(F.date_add("day", -1), "day", F.date_add("day", 1))))
    i = o.select(F.col("o_orderkey").alias("other"), F.col("context").alias("c"), F.col("day").alias("d"))
    pairs = keyed.join(i, F.col("context").eqNullSafe(F.col("c")) & (F.col("key") == F.col("d")) & (F.col("other") < F.col("o_orderkey")))
    return pairs.groupBy(F.col("o_orderkey").alias("finding")).agg(F.count("*").alias("candidates"))
