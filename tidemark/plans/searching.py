"""Queries over full-text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..operators import search as S
from ..sources.folders import work_folder
from ..sources.tables import table
from .registry import query

FOLDED = "translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"
WORDS = f"(SELECT doc_id, source, n_chars, text, regexp_extract_all({FOLDED}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)"
JOINED = f"(SELECT doc_id, source, n_chars, text, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM {WORDS})"


def _matching(spark, sf, typed):
    docs = table(spark, sf, "documents")
    return docs.where(S.holds(tokens(F.col("text")), S.parse(typed)))


@query(f"""
WITH d AS {JOINED}, s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
t AS (SELECT doc_id, j, len(w) AS size, 10.0 * len(list_filter(w, lambda x: x = 'the')) AS a, 10.0 * len(list_filter(w, lambda x: starts_with(x, 'ereat'))) AS b FROM d),
f AS (SELECT sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM t)
SELECT doc_id, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)), 5) AS score
FROM t, s, f WHERE j LIKE '% the %' AND j LIKE '% ereat%'""")
def search_items_bm25(spark, sf):
    """Two words, the last a prefix, ranked."""
    found = S.ranked(table(spark, sf, "documents"), "doc_id", {"title": ("text", 10.0)}, S.parse("The ereat"))
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"))


def _index(spark, sf):
    """An index of the documents, stored once for each session and folder."""
    known = _indexes.setdefault(spark.sparkContext.applicationId, {})
    if sf not in known:
        known[sf] = work_folder(spark, "index")
        S.write_index(table(spark, sf, "documents").where("text is not null"), "doc_id", {"title": ("text", 10.0)}, known[sf])
    return S.Index(spark, known[sf])


_indexes: dict = {}


@query(f"""
WITH d AS {JOINED}, s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(w) AS size, 10.0 * len(list_filter(w, lambda x: starts_with(x, 'ereat'))) AS a, 10.0 * len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS b, j FROM d WHERE text IS NOT NULL),
f AS (SELECT sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM t)
SELECT doc_id, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)), 5) AS score
FROM t, s, f WHERE a > 0 AND b > 0 AND j NOT LIKE '% was %'""")
def search_stored_index(spark, sf):
    """A phrase, an excluded word and a prefix over a stored index: only the words' folders are read."""
    found = _index(spark, sf).search(S.parse('"of the" -was ereat'))
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"))


@query(f"SELECT doc_id FROM {JOINED} WHERE j LIKE '% of the %'")
def search_phrase(spark, sf):
    return _matching(spark, sf, '"of the').select("doc_id")


@query(f"SELECT doc_id FROM {JOINED} WHERE j LIKE '% the %' AND j LIKE '% thr%'")
def search_prefix(spark, sf):
    return _matching(spark, sf, "the thr").select("doc_id")


@query(f"SELECT doc_id FROM {JOINED} WHERE j LIKE '% the %' AND j NOT LIKE '% was %' AND j NOT LIKE '% in the %'")
def search_not(spark, sf):
    return _matching(spark, sf, 'the -was -"in the" "the"').select("doc_id")


@query(f"SELECT doc_id, k::BIGINT AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM {JOINED} WHERE j LIKE '% con%') WHERE k BETWEEN 11 AND 31")
def search_captures(spark, sf):
    """A page of capture hits, newest first, one row more than the page to tell whether there are more."""
    page = _matching(spark, sf, "con").orderBy(F.col("n_chars").desc(), "doc_id").offset(10).limit(21).select("doc_id", "n_chars")
    return page.withColumn("place", (F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")) + 10).cast("long")).select("doc_id", "place")


@query("""
SELECT doc_id, CASE WHEN strpos(lower(text), 'tion') > 0 THEN substr(text, greatest(1, strpos(lower(text), 'tion') - 46), 140) ELSE left(text, 140) END AS excerpt FROM documents""")
def search_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.excerpt(F.col("text"), "tion").alias("excerpt"))


@query(f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, line, n FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM d)),
m AS (SELECT doc_id, n, (contains(x, ' the '))::INT + (contains(x, ' of '))::INT + (contains(x, ' and '))::INT AS words FROM
  (SELECT doc_id, n, ' ' || array_to_string(regexp_extract_all({FOLDED.replace('text', 'line')}, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS x FROM l)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, n) AS k FROM m WHERE words > 0)
SELECT doc_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS best_lines FROM r WHERE k <= 3 GROUP BY doc_id""")
def search_best_lines(spark, sf):
    """The three lines with most of the words, shown in their own order."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    x = F.concat(F.lit(" "), F.array_join(tokens(F.col("line")), " "), F.lit(" "))
    words = sum((x.contains(f" {w} ").cast("int") for w in ("the", "of", "and")), F.lit(0))
    hit = lines.select("doc_id", "n", words.alias("words")).where("words > 0")
    best = hit.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("words").desc(), "n"))).where("k <= 3")
    return best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda v: v.cast("string")), ",").alias("best_lines"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'e') THEN 'title' WHEN contains(lower(p_brand), '3') THEN 'alias' WHEN contains(lower(p_type), 's') THEN 'notes' ELSE 'none' END AS field FROM part")
def search_matched_field(spark, sf):
    """The first field, in order of rank, that holds a mark."""
    m = lambda c, w: fold(F.col(c)).contains(w)
    return table(spark, sf, "part").select("p_partkey", F.when(m("p_name", "e"), "title").when(m("p_brand", "3"), "alias").when(m("p_type", "s"), "notes").otherwise("none").alias("field"))


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS stored, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0)::BIGINT AS indexed")
def index_health(spark, sf):
    """Stored and indexed documents have to agree."""
    return table(spark, sf, "documents").agg(F.count("*").alias("stored"), F.countDistinct(F.when(F.length("text") > 0, F.col("doc_id"))).alias("indexed"))


@query(f"""
WITH w AS (SELECT doc_id, unnest(w) AS token FROM {WORDS}), d AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1)
SELECT token, n::BIGINT AS n, docs::BIGINT AS docs FROM d""")
def index_terms(spark, sf):
    """The index's terms with their frequencies."""
    return S.term_counts(table(spark, sf, "documents"), "doc_id", "text")
