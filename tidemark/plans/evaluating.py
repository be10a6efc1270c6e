"""Queries over evaluation: matching, precision and recall, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import compact, evaluation_similarity
from ..operators.evaluation import greedy_match, merge_quality
from ..sources.tables import table
from .registry import query
from .texts import FIRST_LINE, first_line


@query("""
WITH x AS (SELECT d.lang, l.quality = 1 AS want, n_chars % 3 > 0 AS got FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT lang, count(*) FILTER (want AND got) AS tp, count(*) FILTER (NOT want AND got) AS fp, count(*) FILTER (want AND NOT got) AS fn FROM x GROUP BY 1)
SELECT lang, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM s""")
def precision_recall_by_lang(spark, sf):
    """Ratios by language; nothing over nothing is one."""
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    want, got = F.col("quality") == 1, F.col("n_chars") % 3 > 0
    n = lambda c: F.count(F.when(c, 1))
    s = joined.groupBy("lang").agg(n(want & got).alias("tp"), n(~want & got).alias("fp"), n(want & ~got).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b == 0, F.lit(1.0)).otherwise(a / b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("lang", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("""
WITH e AS (SELECT vec_id, label AS event, label * 10 + vec_id % 2 AS item FROM embeddings),
g AS (SELECT event, item, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT sum(n * (n - 1) / 2) AS together FROM g), q AS (SELECT sum(n * (n - 1) / 2) AS wanted FROM (SELECT event, count(*) AS n FROM e GROUP BY 1)),
w AS (SELECT count(*) FILTER (k > 1) AS wrong, count(*) AS items FROM (SELECT item, count(DISTINCT event) AS k FROM e GROUP BY 1))
SELECT round(together::DOUBLE / wanted, 6) AS recall, wrong::BIGINT AS wrong, items::BIGINT AS items FROM p, q, w""")
def embed_merge_recall(spark, sf):
    """Pairs of one event in one item, and items that hold several events; counted without making pairs."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("event"), (F.col("label") * 10 + F.col("vec_id") % 2).alias("item"))
    return merge_quality(e)


@query("""
WITH t AS (SELECT doc_id, regexp_replace(lower(translate(""" + FIRST_LINE + """, 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÛÜÑÇß', 'aaaaaaeeeeiiiiooooouuuuncyyAAAAEEEEIIIOOOUUUNCs')), '[^a-z0-9]', '', 'g') AS c FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.c AS x, b.c AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT a, b, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN least(length(x), length(y)) >= 3 AND (contains(x, y) OR contains(y, x))
 THEN greatest(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 0.8 + 0.2 * least(length(x), length(y))::DOUBLE / greatest(length(x), length(y)) * 0.99)
 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END, 6) AS score FROM p""")
def evaluation_similarities(spark, sf):
    """How evaluation compares titles, on neighbouring documents."""
    plain = F.translate(first_line(), "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÛÜÑÇß", "aaaaaaeeeeiiiiooooouuuuncyyAAAAEEEEIIIOOOUUUNCs")
    t = table(spark, sf, "documents").select("doc_id", F.regexp_replace(compact(plain), "[^a-z0-9]", "").alias("c"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("c").alias("y"))
    return t.join(other, "doc_id").select(F.col("doc_id").alias("a"), "b", F.round(evaluation_similarity(F.col("c"), F.col("y")), 6).alias("score"))


@query("""
WITH g AS (SELECT page_id, page_id % 5 AS k, 'v' || page_id % 3 AS want, CASE WHEN page_id % 7 > 0 THEN 'v' || page_id % 4 END AS got FROM pages)
SELECT k::BIGINT AS tag, count(*) FILTER (want = got)::BIGINT AS correct, count(*) FILTER (want <> got)::BIGINT AS wrong, count(*) FILTER (got IS NULL)::BIGINT AS missing FROM g GROUP BY 1""")
def tag_score(spark, sf):
    """Correct, wrong and missing tags by key."""
    p = F.col("page_id")
    want, got = F.concat(F.lit("v"), (p % 3).cast("string")), F.when(p % 7 > 0, F.concat(F.lit("v"), (p % 4).cast("string")))
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, sf, "pages").groupBy((p % 5).cast("long").alias("tag")).agg(n(want == got).alias("correct"), n(want != got).alias("wrong"), n(got.isNull()).alias("missing"))


@query("""
WITH a AS (SELECT source AS name, avg(n_chars) AS v FROM documents WHERE doc_id % 40 < 20 GROUP BY 1), b AS (SELECT source AS name, avg(n_chars) AS v FROM documents WHERE doc_id % 40 >= 20 GROUP BY 1)
SELECT name, round(b.v - a.v, 4) AS delta FROM a JOIN b USING (name) WHERE abs(b.v - a.v) > 1e-9""")
def report_compare(spark, sf):
    """Cases whose value changed between two reports."""
    d = table(spark, sf, "documents")
    side = lambda k, name: d.where(F.floor(F.col("doc_id") % 40 / 20) == k).groupBy(F.col("source").alias("name")).agg(F.avg("n_chars").alias(name))
    both = side(0, "a").join(side(1, "b"), "name").withColumn("delta", F.col("b") - F.col("a"))
    return both.where(F.abs("delta") > 1e-9).select("name", F.round("delta", 4).alias("delta"))


@query("""
WITH s AS (SELECT p_size AS size, avg(p_retailprice) AS f1 FROM part GROUP BY 1), b AS (SELECT max(f1) AS best FROM s)
SELECT min(size)::INT AS size, count(*)::BIGINT AS close FROM s, b WHERE f1 >= best * 0.98""")
def size_sweep(spark, sf):
    """The smallest size close enough to the best."""
    s = table(spark, sf, "part").groupBy(F.col("p_size").alias("size")).agg(F.avg("p_retailprice").alias("f1"))
    best = s.agg(F.max("f1").alias("best"))
    return s.crossJoin(F.broadcast(best)).where(F.col("f1") >= F.col("best") * 0.98).agg(F.min("size").alias("size"), F.count("*").alias("close"))


@query()
def greedy_matches(spark, sf):
    """One-to-one matches of expected and found findings within a case, best first; a test compares it with a plain walk."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id")).alias("case"), F.col("turn").alias("id"), compact(F.coalesce("text", F.lit(""))).alias("title"), F.col("turn").alias("at"))
    want, got = rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1")
    return greedy_match(want, got, least=0.2, most_gap=5)
