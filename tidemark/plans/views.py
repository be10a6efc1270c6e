"""Queries over calendar views. Suppliers are pictures of months, order lines the labels and entries that were read in them.

The pictures are made by one text in the common part of both dialects; only the names of three date functions differ.
Labels are missing and jitter, other windows show numbers, titles stand above the grid, beside it, nowhere, or disagree with a label.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import clocks
from ..operators import grids as G
from ..operators import headers as H
from ..sources.tables import table
from .registry import query

PICTURES = """SELECT DISTINCT l_suppkey AS image, make_date(CAST(2023 + floor((l_suppkey % 36) / 12) AS INT), CAST(l_suppkey % 12 + 1 AS INT), 1) AS first FROM lineitem"""
MONTHS = f"""
SELECT image, n, text, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(CASE WHEN w > 0 THEN w ELSE 8 * length(text) END AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM (
  SELECT image, CAST(k + 1 AS BIGINT) AS n, CASE WHEN image % 4 = 1 AND day(d) = 1 THEN concat('1 ', lower(MON(d))) ELSE CAST(day(d) AS STRING) END AS text,
    100 + k % 7 * 90 + o % 3 AS x, 200 + floor(k / 7) * 80 + o % 2 AS y, 0 AS w, 14 AS h
  FROM (SELECT l.image, l.k, l.o, p.first - CAST(FROM_MONDAY(p.first) AS INT) + l.k AS d
    FROM (SELECT l_suppkey AS image, CAST(l_partkey % 42 AS INT) AS k, min(l_orderkey) AS o FROM lineitem WHERE l_orderkey % 25 < 2 GROUP BY l_suppkey, CAST(l_partkey % 42 AS INT)) l
    JOIN ({PICTURES}) p ON p.image = l.image) q
  UNION ALL SELECT image, 900, concat(MONTH_NAME(first), ' ', CAST(year(first) AS STRING)), 300, 100, 120, 20 FROM ({PICTURES}) p WHERE image % 4 IN (0, 3)
  UNION ALL SELECT image, 901, CASE WHEN month(first) < 7 THEN '1 oct' ELSE '1 mar' END, 100, 150, 40, 14 FROM ({PICTURES}) p WHERE image % 4 = 3
  UNION ALL SELECT image, 902, 'March 2020', 1200, 110, 120, 20 FROM ({PICTURES}) p WHERE image % 8 = 0
  UNION ALL SELECT image, 910 + j, CAST(12 + j AS STRING), 1000, 30 + 40 * j, 0, 14 FROM ({PICTURES}) p CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1) u WHERE image % 3 = 0
  UNION ALL SELECT image, 912, '3', 1100, 40, 0, 14 FROM ({PICTURES}) p WHERE image % 5 = 0
  UNION ALL SELECT l_suppkey, 1000 + l_orderkey * 8 + l_linenumber,
    CASE l_partkey % 5 WHEN 0 THEN concat('9:', CAST(10 + l_partkey % 50 AS STRING), ' Visit plant') WHEN 1 THEN concat('• Visit dock ', CAST(10 + l_partkey % 9 AS STRING), ':05')
      WHEN 2 THEN 'Call | ' WHEN 3 THEN '+3 more' ELSE '* 7' END,
    104 + l_partkey % 7 * 90, 220 + floor(l_partkey % 42 / 7) * 80 + l_linenumber % 3 * 12, 60, 10 FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_orderkey % 25 = 5 GROUP BY l_suppkey, l_orderkey, l_linenumber) e25
  UNION ALL SELECT l_suppkey, 2000000000 + l_orderkey * 8 + l_linenumber, concat('16:', CAST(10 + l_partkey % 50 AS STRING)), 140 + l_partkey % 7 * 90,
    220 + floor(l_partkey % 42 / 7) * 80 + l_linenumber % 3 * 12, 26, 10 FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_orderkey % 50 = 5 GROUP BY l_suppkey, l_orderkey, l_linenumber) e50) made"""


#: Names of weekdays and months in both dialects: Spark's and the checking engine's.
NAMES = {
    "FROM_MONDAY": ("weekday({})", "(isodow({}) - 1)"), "MON": ("date_format({}, 'MMM')", "strftime({}, '%b')"), "MONTH_NAME": ("date_format({}, 'MMMM')", "strftime({}, '%B')"),
    "DAY_NAME": ("date_format({}, 'EEEE')", "strftime({}, '%A')"), "HOURS": ("date_format({}, 'HH:mm')", "strftime({}, '%H:%M')"),
    "LONG_CLOCK": ("date_format({}, 'EEE d MMM HH:mm')", "strftime({}, '%a %-d %b %H:%M')"), "WEEK_CLOCK": ("date_format({}, 'EEE d HH:mm')", "strftime({}, '%a %-d %H:%M')"),
    "YEAR_CLOCK": ("date_format({}, 'yyyy-MM-dd HH:mm')", "strftime({}, '%Y-%m-%d %H:%M')"),
}


def spoken(sql: str, spark: bool) -> str:
    """The common text in one of the dialects."""
    for word, forms in NAMES.items():
        sql = re.sub(rf"\b{word}\(([\w.]+)\)", lambda m, form=forms[not spark]: form.format(m[1]), sql)
    minutes = r"timestampadd(MINUTE, CAST(\2 AS INT), \1)" if spark else r"(\1 + to_minutes(CAST(\2 AS BIGINT)))"
    sql = re.sub(r"\bLATER\(([\w.]+), ([^()]+)\)", minutes, sql)
    return sql if spark else sql.replace("STRING", "VARCHAR")


def _lines(spark, sf):
    return spark.sql(spoken(MONTHS, True).replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))


def _pictures(spark, sf):
    made = spark.sql(PICTURES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return made.select("image", F.date_add("first", 14).alias("today"))


MEDIAN = "list_sort(list({0}) FILTER ({0} IS NOT NULL))[(count({0}) // 2 + 1)::INT]"
#: Cells of the month views: labels by lag and running sums into columns and rows, then votes for the first day.
CELLS = rf"""lines AS ({spoken(MONTHS, False)}), pics AS ({PICTURES}),
lab AS (SELECT *, x + w / 2 AS mx, y + h / 2 AS my, try_cast(text AS INT) AS number FROM lines WHERE regexp_full_match(trim(text), '[0-9]{{1,2}}') AND try_cast(text AS INT) BETWEEN 1 AND 31),
near AS (SELECT image, greatest(8, {MEDIAN.format("h")}) AS near FROM lab GROUP BY image HAVING count(*) >= 7),
c1 AS (SELECT lab.*, near, (mx - coalesce(lag(mx) OVER (PARTITION BY lab.image ORDER BY mx, n), mx) > near)::INT AS new FROM lab JOIN near ON near.image = lab.image),
c2 AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY mx, n) AS colno FROM c1),
c3 AS (SELECT image, colno, min(mx) AS pos, count(*) AS labels FROM c2 GROUP BY 1, 2 HAVING count(*) >= 2),
c4 AS (SELECT *, pos - lag(pos) OVER (PARTITION BY image ORDER BY pos) AS gap FROM c3),
c5 AS (SELECT image, {MEDIAN.format("gap")} AS usual FROM c4 GROUP BY 1),
c6 AS (SELECT c4.*, sum(coalesce(abs(gap - usual) > usual * 0.25, false)::INT) OVER (PARTITION BY c4.image ORDER BY pos) AS chain FROM c4 JOIN c5 ON c5.image = c4.image),
c7 AS (SELECT image, arg_max(chain, (total, -chain)) AS chain FROM (SELECT image, chain, sum(labels) AS total FROM c6 GROUP BY 1, 2) GROUP BY 1 HAVING max(total) >= 7),
kept AS (SELECT c2.* FROM c2 JOIN c6 ON c6.image = c2.image AND c6.colno = c2.colno JOIN c7 ON c7.image = c6.image AND c7.chain = c6.chain),
tall AS (SELECT image, greatest(1, {MEDIAN.format("h")}) AS tall, min(round(mx / 4) * 4) AS "left", min(my) AS top FROM kept GROUP BY 1),
rx AS (SELECT image, axis, pos, pos - lag(pos) OVER (PARTITION BY image, axis ORDER BY pos) AS gap FROM (
  SELECT image, axis, min(v) AS pos FROM (SELECT *, sum(new) OVER (PARTITION BY image, axis ORDER BY v, n) AS g FROM (
    SELECT u.*, (v - coalesce(lag(v) OVER (PARTITION BY u.image, axis ORDER BY v, n), v) > tall)::INT AS new
    FROM (SELECT image, n, 'x' AS axis, mx AS v FROM kept UNION ALL SELECT image, n, 'y', my FROM kept) u JOIN tall ON tall.image = u.image)) GROUP BY image, axis, g)),
sp AS (SELECT image, axis, list_sort(list_filter(list(gap) FILTER (gap > 1), lambda g: g <= 1.5 * list_min(list(gap) FILTER (gap > 1)))) AS s FROM rx GROUP BY 1, 2),
size AS (SELECT tall.*, wide.s[len(wide.s) // 2 + 1] AS width, coalesce(high.s[len(high.s) // 2 + 1], wide.s[len(wide.s) // 2 + 1]) AS height FROM tall JOIN sp wide ON wide.image = tall.image AND wide.axis = 'x' LEFT JOIN sp high ON high.image = tall.image AND high.axis = 'y'),
placed AS (SELECT kept.*, size.width, size.height, size."left", size.top, round((my - size.top) / size.height)::INT AS r, round((mx - size."left") / size.width)::INT AS c FROM kept JOIN size ON size.image = kept.image
  QUALIFY min(c) OVER (PARTITION BY kept.image) >= 0 AND max(c) OVER (PARTITION BY kept.image) <= 6),
edge AS (SELECT image, c, k, {MEDIAN.format("a")} + any_value(shift) AS mid, max(a) - min(a) AS spread FROM (SELECT image, c, unnest([0, 1, 2]) AS k, unnest([x::DOUBLE, mx, (x + w)::DOUBLE]) AS a, unnest([width / 2, 0, -width / 2]) AS shift FROM placed) GROUP BY 1, 2, 3),
pick AS (SELECT image, arg_min(k, (spread, k)) AS k FROM (SELECT image, k, sum(spread) AS spread FROM edge GROUP BY 1, 2) GROUP BY 1),
centre AS (SELECT z.image, z.c, z.width, arg_min(e.mid + (z.c - e.c) * z.width, (abs(e.c - z.c), e.c)) AS mid FROM (SELECT DISTINCT image, width, unnest(range(7))::INT AS c FROM placed) z JOIN edge e ON e.image = z.image JOIN pick ON pick.image = e.image AND pick.k = e.k GROUP BY 1, 2, 3),
says AS (SELECT l.*, x + w / 2 AS mx, y + h / 2 AS my, try_strptime(text, '%B %Y') AS title, CASE WHEN text[1:2] = '1 ' THEN month(try_strptime(text || ' 2000', '%-d %b %Y')) END AS named FROM lines l),
title AS (SELECT s.image, arg_min(s.title, (NOT (s.mx BETWEEN a.mid - a.width / 2 AND b.mid + b.width / 2), -s.my)) AS title FROM says s JOIN centre a ON a.image = s.image AND a.c = 0 JOIN centre b ON b.image = s.image AND b.c = 6 JOIN size ON size.image = s.image
  WHERE s.title IS NOT NULL AND s.my < size.top GROUP BY 1),
named AS (SELECT image, list(named ORDER BY n) AS months FROM says WHERE named IS NOT NULL GROUP BY 1),
shown AS (SELECT p.image, coalesce(month(title), months[1], month(first + 14)) AS m, coalesce(year(title), year(first + 14)) AS y, title IS NULL AND months IS NULL AS assumed,
  list_concat(CASE WHEN title IS NULL THEN [] ELSE [month(title)] END, coalesce(months, [])) AS told FROM pics p LEFT JOIN title ON title.image = p.image LEFT JOIN named ON named.image = p.image),
shown2 AS (SELECT image, make_date(y::INT, m::INT, 1) AS one, assumed, len(list_filter(told, lambda a: len(list_filter(told, lambda b: least(abs(a - b), 12 - abs(a - b)) > 1)) > 0)) > 0 AS conflict FROM shown),
votes AS (SELECT image, start, count(*) AS n, any_value(one) AS one FROM (SELECT p.image, one, mon, p.number, (mon + p.number::INT - 1 - p.r * 7 - p.c)::DATE AS start
  FROM (SELECT placed.*, one, unnest([(one - INTERVAL 1 MONTH)::DATE, one, (one + INTERVAL 1 MONTH)::DATE]) AS mon FROM placed JOIN shown2 ON shown2.image = placed.image) p WHERE p.number <= day(last_day(mon))) GROUP BY 1, 2),
start AS (SELECT image, arg_max(start, (n, -abs(start - one), -(start - DATE '1970-01-01'))) AS start FROM votes GROUP BY 1),
grid AS (SELECT image, top, height, width, unnest(range((max(r) + 1) * 7))::INT AS k FROM placed GROUP BY image, top, height, width),
cells AS (SELECT g.image, g.k, coalesce(max(p.n), -(g.k + 1))::BIGINT AS line, any_value(centre.mid) AS mid_x, coalesce(arg_max(p.my, p.n), any_value(g.top + g.k // 7 * g.height)) AS mid_y, any_value(g.width) AS width,
  any_value(start.start + g.k) AS day, any_value(s.assumed) AS assumed, any_value(s.conflict) AS conflict
  FROM grid g JOIN centre ON centre.image = g.image AND centre.c = g.k % 7 JOIN start ON start.image = g.image JOIN shown2 s ON s.image = g.image LEFT JOIN placed p ON p.image = g.image AND p.r = g.k // 7 AND p.c = g.k % 7 GROUP BY 1, 2)"""


@query(f"""WITH {CELLS}
SELECT image, line, mid_x::DOUBLE AS mid_x, mid_y::DOUBLE AS mid_y, day::DATE::VARCHAR AS day, assumed, conflict FROM cells""")
def month_cells(spark, sf):
    """Every day cell of the month views, with the date its place gives."""
    cells = G.month_cells(_lines(spark, sf), _pictures(spark, sf)).select("image", F.inline("cells"))
    return cells.select("image", "line", "mid_x", "mid_y", F.col("day").cast("string").alias("day"), "assumed", "conflict")


@query(rf"""WITH {CELLS},
ent AS (SELECT l.*, y + h / 2 AS my, CASE WHEN regexp_matches(text, '^[0-9]+:[0-9]+ ') THEN split_part(text, ' ', 1) WHEN regexp_matches(text, ' [0-9]+:[0-9]+$') THEN split_part(text, ' ', 4) END AS said,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '^[•* ]+|[| ]+$', ''), '^[0-9]+:[0-9]+ ', ''), ' [0-9]+:[0-9]+$', '')) AS title FROM lines l
  WHERE n >= 1000 AND n < 2000000000 AND text <> '+3 more' AND regexp_matches(text, '[A-Za-z]')),
clk AS (SELECT image, text, x, x + w / 2 AS mx, y + h / 2 AS my FROM lines WHERE regexp_full_match(text, '[0-9]+:[0-9]+')),
col AS (SELECT image, min(k) AS k, floor(mid_x - width / 2) - 2 AS a, mid_x - width / 2 AS b, mid_x + width / 2 AS c FROM cells GROUP BY ALL),
own AS (SELECT e.image, e.n, arg_min((b, c), col.k) AS col FROM ent e JOIN col ON col.image = e.image AND e.x >= a AND e.x < c GROUP BY 1, 2),
beside AS (SELECT e.image, e.n, arg_min(clk.text, (clk.x, clk.mx, clk.my, clk.text)) AS clock FROM ent e JOIN own ON own.image = e.image AND own.n = e.n JOIN clk ON clk.image = e.image AND clk.x > e.x
  AND clk.mx >= own.col[1] AND clk.mx < own.col[2] AND abs(clk.my - e.my) <= greatest(4, 0.6 * e.h) GROUP BY 1, 2),
at_ AS (SELECT e.image, e.n, arg_min((cells.day, cells.assumed, cells.conflict), (3 * abs(cells.mid_x - cells.width / 2 - e.x) + e.my - cells.mid_y, cells.day)) AS cell FROM ent e JOIN cells ON cells.image = e.image AND cells.mid_y <= e.my GROUP BY 1, 2),
many AS (SELECT image FROM cells GROUP BY 1 HAVING count(*) >= 28)
SELECT e.image, e.n, e.title, coalesce(e.said, beside.clock) AS clock, at_.cell[1]::DATE::VARCHAR AS day, at_.cell[2] AS assumed, at_.cell[3] AS conflict FROM ent e JOIN many ON many.image = e.image LEFT JOIN beside ON beside.image = e.image AND beside.n = e.n LEFT JOIN at_ ON at_.image = e.image AND at_.n = e.n""")
def month_entries(spark, sf):
    """The entries of month views with their own or their row's time and their cell's day."""
    lines = _lines(spark, sf)
    found = G.month_entries(lines.where("n >= 1000"), G.month_cells(lines, _pictures(spark, sf)))  # lines of the window itself have smaller numbers
    return found.withColumn("day", F.col("day").cast("string"))


#: Week views: names and numbers on one line or two, in two languages, with and without the month; columns are missing.
WEEKS = f"""
SELECT image, n, text, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(8 * length(text) AS BIGINT) AS w, CAST(14 AS BIGINT) AS h FROM (
  SELECT image, CAST(2 * k + 1 AS BIGINT) AS n, CASE WHEN image % 5 = 1 THEN substring(DAY_NAME(d), 1, 3)
      WHEN image % 5 = 2 AND k % 3 = 0 THEN concat(DAY_NAME(d), ', ', MONTH_NAME(d), ' ', CAST(day(d) AS STRING), ', ', CAST(year(d) AS STRING))
      WHEN image % 5 = 3 THEN concat(CASE k WHEN 0 THEN 'lun' WHEN 1 THEN 'mar' WHEN 2 THEN 'mié' WHEN 3 THEN 'jue' WHEN 4 THEN 'vie' WHEN 5 THEN 'sáb' ELSE 'dom' END, ' ', CAST(day(d) AS STRING))
      WHEN image % 5 = 4 AND k = 3 THEN concat('Thu ', CAST(day(d) AS STRING), ' ', MONTH_NAME(d))
      ELSE concat(substring(DAY_NAME(d), 1, 3), ' ', CAST(day(d) AS STRING)) END AS text, 120 + k * 110 + o % 5 AS x, 60 + o % 2 AS y, d, k, o
  FROM (WEEK) q
  UNION ALL SELECT image, CAST(2 * k + 2 AS BIGINT), CAST(day(d) AS STRING), 122 + k * 110 + o % 3, 82, d, k, o FROM (WEEK) q WHERE image % 5 = 1
  UNION ALL SELECT image, 900, concat(MONTH_NAME(first), ' ', CAST(year(first) AS STRING)), 300, 10, first, 0, 0 FROM ({PICTURES}) p WHERE image % 5 < 2 AND image % 2 = 0
  UNION ALL SELECT image, 901, CASE WHEN month(first) < 7 THEN 'December' ELSE 'February' END, 300, 10, first, 0, 0 FROM ({PICTURES}) p WHERE image % 5 = 4
  UNION ALL SELECT l_suppkey, 1000 + max(l_linenumber) + 8 * l_orderkey, 'Visit plant', 104 + min(l_partkey) % 800, 300, DATE '2000-01-01', 0, 0 FROM lineitem WHERE l_orderkey % 75 = 5 GROUP BY l_suppkey, l_orderkey) made""".replace("WEEK", f"""
    SELECT l.image, l.k, l.o, s.d0 - CAST(FROM_MONDAY(s.d0) AS INT) + l.k AS d FROM (SELECT l_suppkey AS image, CAST(l_partkey % 7 AS INT) AS k, min(l_orderkey) AS o FROM lineitem WHERE l_orderkey % 150 < 2 GROUP BY l_suppkey, CAST(l_partkey % 7 AS INT)) l
    JOIN (SELECT image, first + CAST(image * 5 % 20 AS INT) AS d0 FROM ({PICTURES}) p) s ON s.image = l.image""")


def _week_lines(spark, sf):
    made = spark.sql(spoken(WEEKS, True).replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return dates.parse(made)


MONTH_NAMES = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"
#: Headers of the week views: words by position in lists of names, pairs of lines by nearest boxes, dates from the months named, gaps filled by lead.
HEADERS = rf"""lines AS ({spoken(WEEKS, False)}), pics AS ({PICTURES}),
p AS (SELECT *, x + w / 2 AS mx, y + h / 2 AS my, coalesce(nullif(list_position(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'], lower(text[1:3])), 0), nullif(list_position(['lun', 'mar', 'mié', 'jue', 'vie', 'sáb', 'dom'], lower(text[1:3])), 0)) AS wd,
  nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{1,2}})(?:[^0-9]|$)', 1), '')::INT AS num, nullif(regexp_extract(text, '((?:19|20)[0-9]{{2}})', 1), '')::INT AS yr, list_max(list_transform(range(1, 13), lambda k: CASE WHEN contains(lower(text), {MONTH_NAMES}[k]) THEN k END)) AS mo FROM lines),
said AS (SELECT image, arg_min(mo, n) AS mo, arg_min(coalesce(yr, 0), n) AS yr FROM p WHERE mo IS NOT NULL AND wd IS NULL OR n IN (900, 901) GROUP BY 1),
pairs AS (SELECT a.image, a.n, a.num, arg_min((b.wd, (least(a.x, b.x) + greatest(a.x + a.w, b.x + b.w)) / 2, (least(a.y, b.y) + greatest(a.y + a.h, b.y + b.h)) / 2), (abs(a.my - b.my), b.n)) AS q
  FROM p a JOIN p b ON b.image = a.image AND a.wd IS NULL AND regexp_full_match(a.text, '[0-9]+') AND b.wd IS NOT NULL AND b.num IS NULL AND abs(a.x - b.x) <= 0.75 * greatest(a.w, b.w) AND abs(a.my - b.my) <= 2.5 * greatest(a.h, b.h) AND a.my <> b.my GROUP BY 1, 2, 3),
heads AS (SELECT image, n, mx, my, wd, num, mo, yr, 0 AS late FROM p WHERE wd IS NOT NULL AND num IS NOT NULL AND n < 900 UNION ALL SELECT image, n, q[2], q[3], q[1], num, NULL, NULL, 1 FROM pairs),
months AS (SELECT image, list_concat(list(mo) FILTER (src = 0), list(mo) FILTER (src = 1)) AS m, arg_min(mo, (src, late, n)) AS mo, arg_min(yr, (src, late, n)) AS yr FROM (SELECT image, mo, yr, 0 AS src, 0 AS late, 0 AS n FROM said UNION ALL SELECT image, mo, coalesce(yr, 0), 1, late, n FROM heads WHERE mo IS NOT NULL) GROUP BY 1),
ctx AS (SELECT h.*, (first + 14)::DATE AS today, m.mo AS hm, nullif(m.yr, 0) AS hy, len(list_filter(coalesce(m.m, []), lambda a: len(list_filter(m.m, lambda b: least(abs(a - b), 12 - abs(a - b)) > 1)) > 0)) > 0 AS conflict FROM heads h JOIN pics ON pics.image = h.image LEFT JOIN months m ON m.image = h.image),
opt AS (SELECT c.image, c.n, c.late, 0 AS rank, 0 AS pos, make_date(yr, mo, num) AS d FROM ctx c WHERE mo IS NOT NULL AND yr IS NOT NULL
  UNION ALL SELECT c.image, c.n, c.late, (isodow(d) <> wd)::INT, abs(d - today), d FROM (SELECT c.*, unnest([try_cast((year(today) + 0) || '-' || mo || '-' || num AS DATE), try_cast((year(today) - 1) || '-' || mo || '-' || num AS DATE), try_cast((year(today) + 1) || '-' || mo || '-' || num AS DATE)]) AS d FROM ctx c WHERE mo IS NOT NULL AND yr IS NULL) c WHERE d IS NOT NULL
  UNION ALL SELECT c.image, c.n, c.late, 0, s, d FROM (SELECT c.*, s, m, CASE WHEN num <= day(last_day(m)) THEN (m + num - 1)::DATE END AS d FROM (SELECT c.*, unnest([0, 1, 2]) AS s, unnest([f, (f - INTERVAL 1 MONTH)::DATE, (f + INTERVAL 1 MONTH)::DATE]) AS m FROM (
    SELECT c.*, make_date(coalesce(hy, (SELECT year(arg_min(o, (isodow(o) <> wd, abs(o - today), o))) FROM (SELECT unnest([try_cast((year(today) - 1) || '-' || hm || '-' || num AS DATE), try_cast(year(today) || '-' || hm || '-' || num AS DATE), try_cast((year(today) + 1) || '-' || hm || '-' || num AS DATE)]) AS o) WHERE o IS NOT NULL), year(today))::INT, hm::INT, 1) AS f
    FROM ctx c WHERE mo IS NULL AND hm IS NOT NULL) c) c) c WHERE d IS NOT NULL AND isodow(d) = wd),
best AS (SELECT image, n, late, arg_min(d, (rank, pos, d)) AS d FROM opt GROUP BY 1, 2, 3),
near AS (SELECT c.image, c.n, c.late, arg_min(d, (abs(d - today), d)) AS d FROM ctx c JOIN (SELECT (DATE '2022-01-01' + k::INT)::DATE AS d FROM range(2000) r(k)) k ON isodow(k.d) = c.wd AND day(k.d) = c.num AND abs(k.d - today) <= 183 GROUP BY 1, 2, 3),
dated AS (SELECT c.image, c.n, c.mx, c.my, c.late, c.conflict, coalesce(best.d, near.d) AS d, best.d IS NULL AS assumed FROM ctx c LEFT JOIN best ON best.image = c.image AND best.n = c.n AND best.late = c.late LEFT JOIN near ON near.image = c.image AND near.n = c.n AND near.late = c.late WHERE coalesce(best.d, near.d) IS NOT NULL),
gaps AS (SELECT *, lead(d) OVER w - d AS gap, lead(mx) OVER w - mx AS dx, count(*) OVER (PARTITION BY image) AS total FROM dated WINDOW w AS (PARTITION BY image ORDER BY mx, late, n)),
headers AS (SELECT image, n AS line, mx, my, d, assumed, conflict FROM gaps UNION ALL SELECT image, 0, mx + dx * k / gap, my, (d + k)::DATE, assumed, conflict FROM (SELECT *, unnest(range(1, gap))::INT AS k FROM gaps WHERE total >= 3 AND gap BETWEEN 2 AND 6))"""


@query(f"WITH {HEADERS} SELECT image, line, mx::DOUBLE AS mid_x, my::DOUBLE AS mid_y, d::VARCHAR AS day, assumed, conflict FROM headers")
def week_headers(spark, sf):
    """The headers of week views with their days; missed columns get theirs from their neighbours."""
    found = H.week_headers(_week_lines(spark, sf), _pictures(spark, sf))
    return found.select("image", F.col("line").cast("long").alias("line"), "mid_x", "mid_y", F.col("day").cast("string").alias("day"), "assumed", "conflict")


@query(f"""WITH {HEADERS}
SELECT p.image, p.n, arg_min(h.line, (abs(h.mx - p.mx), h.mx, -h.line))::BIGINT AS header, arg_min(h.d, (abs(h.mx - p.mx), h.mx, -h.line))::VARCHAR AS day FROM p JOIN headers h ON h.image = p.image WHERE p.n >= 1000 GROUP BY 1, 2""")
def nearest_headers(spark, sf):
    """The header that each entry of a week view stands under."""
    lines = _week_lines(spark, sf)
    entries = lines.where("n >= 1000").select("image", "n", (F.col("x") + F.col("w") / 2).alias("mx"))
    found = H.nearest_header(entries, H.week_headers(lines, _pictures(spark, sf)))
    return found.where("header is not null").select("image", "n", F.col("header").cast("long").alias("header"), F.col("day").cast("string").alias("day"))


#: Orders are screens, their lines windows. Clocks are near, far, of other days, without a month, wrong, or missing.
SHOTS = """SELECT o_orderkey AS shot, LATER(o_orderdate, o_orderkey % 1440) AS captured, o_orderkey % 7 > 0 AS per_window, o_orderkey % 11 = 0 AS window_only FROM orders"""
WINDOWS = f"""SELECT s.shot, l.win AS window_, l.win % 2 = 0 AS remote, 40 * l.win AS y, 200 + 10 * l.q AS h, s.captured, 1000 AS picture_height, s.per_window, s.window_only
  FROM ({SHOTS}) s JOIN (SELECT l_orderkey, CAST(l_linenumber AS INT) AS win, max(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY l_orderkey, CAST(l_linenumber AS INT)) l ON l.l_orderkey = s.shot"""
CLOCKS = f"""
SELECT shot, CASE WHEN per_window THEN CAST(NULL AS INT) ELSE 1 END AS window_, CASE shot % 6 WHEN 0 THEN LONG_CLOCK(soon) WHEN 1 THEN HOURS(soon) WHEN 2 THEN WEEK_CLOCK(soon) WHEN 3 THEN LONG_CLOCK(late)
    WHEN 4 THEN 'Files' ELSE YEAR_CLOCK(soon) END AS text, 900 AS x, CASE WHEN shot % 8 = 7 THEN 60 ELSE 5 END AS y, 80 AS w, 14 AS h
  FROM (SELECT *, LATER(captured, shot % 5 * 60) AS soon, LATER(captured, 57600 + shot % 100) AS late FROM ({SHOTS}) q) s
UNION ALL SELECT shot, window_, CASE shot % 3 WHEN 0 THEN HOURS(soon) WHEN 1 THEN WEEK_CLOCK(late) ELSE concat('Sat ', CAST(1 + shot % 31 AS STRING), ' 10:15') END, 10, CASE WHEN shot % 5 = 0 THEN y + 100 ELSE y + h - 12 END, 60, 12
  FROM (SELECT *, LATER(captured, 60) AS soon, LATER(captured, 4320) AS late FROM ({WINDOWS}) w) v WHERE shot % 4 > 0
UNION ALL SELECT shot, window_, '10:00', 10, y + 100, 60, 12 FROM ({WINDOWS}) w"""


@query(rf"""WITH shots AS ({spoken(SHOTS, False)}), wins AS ({spoken(WINDOWS, False)}), lines AS ({spoken(CLOCKS, False)}),
strips AS (SELECT w.shot, w.window_, w.captured, 0 AS kind, l.text, l.x, l.y + l.h / 2 AS my FROM wins w JOIN lines l ON l.shot = w.shot AND l.window_ = w.window_ AND w.remote AND (l.y + l.h / 2 <= w.y + 0.06::DOUBLE * w.h OR l.y + l.h / 2 >= w.y + w.h - 0.06::DOUBLE * w.h)
  UNION ALL SELECT w.shot, w.window_, w.captured, 1, l.text, l.x, l.y + l.h / 2 FROM wins w JOIN lines l ON l.shot = w.shot AND NOT w.window_only AND l.y + l.h / 2 <= 30 AND (l.window_ IS NULL) = w.per_window),
parsed AS (SELECT *, captured::DATE AS today, regexp_extract(text, '([0-9]{{2}}):', 1) AS hh, regexp_extract(text, ':([0-9]{{2}})', 1) AS mm, nullif(regexp_extract(text, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}) ', 1), '') AS iso,
  nullif(list_position(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], text[1:3]), 0) AS wd, nullif(regexp_extract(text, '^[A-Z][a-z]+ ([0-9]+) ', 1), '')::INT AS num,
  nullif(list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], regexp_extract(text, '^[A-Z][a-z]+ [0-9]+ ([A-Z][a-z]+)', 1)), 0) AS mo FROM strips WHERE contains(text, ':')),
days AS (SELECT p.*, CASE WHEN iso IS NOT NULL THEN iso::DATE WHEN num IS NULL THEN today
  WHEN mo IS NULL THEN list_filter(list_transform([date_trunc('month', today)::DATE, (date_trunc('month', today) - INTERVAL 1 MONTH)::DATE, (date_trunc('month', today) + INTERVAL 1 MONTH)::DATE], lambda m: CASE WHEN num <= day(last_day(m)) THEN m + num - 1 END), lambda d: isodow(d) = wd)[1]
  ELSE list_sort(list_transform(list_filter(list_transform([0, -1, 1], lambda k: try_cast((year(today) + k) || '-' || mo || '-' || num AS DATE)), lambda d: d IS NOT NULL AND isodow(d) = wd), lambda d: {{'gap': abs(epoch(d + (hh || ':' || mm)::TIME) - epoch(captured)), 'd': d}}))[1].d END AS d FROM parsed p),
clocks AS (SELECT shot, window_, kind, arg_min(d::DATE + (hh || ':' || mm)::TIME, (my, x, text)) AS t FROM days WHERE d IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT shot, window_, arg_min(t, kind) AS t, min(kind) AS kind FROM clocks GROUP BY 1, 2)
SELECT w.shot, w.window_ AS "window", strftime(CASE WHEN t IS NULL OR abs(epoch(t) - epoch(w.captured)) > 86400 THEN w.captured ELSE t END, '%Y-%m-%d %H:%M:%S') AS instant,
  CASE WHEN t IS NULL THEN 'capture' WHEN abs(epoch(t) - epoch(w.captured)) > 86400 THEN 'capture-far-clock' WHEN kind = 0 THEN 'window-clock' ELSE 'screen-clock' END AS source,
  CASE WHEN t IS NULL THEN w.per_window AND NOT w.window_only ELSE abs(epoch(t) - epoch(w.captured)) > 86400 END AS guess FROM wins w LEFT JOIN best ON best.shot = w.shot AND best.window_ = w.window_""")
def reference_clocks(spark, sf):
    """The clock that each window's dates are relative to, and whether it is a guess."""
    of = lambda sql: spark.sql(spoken(sql, True).replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}"), lineitem=table(spark, sf, "lineitem"), orders=table(spark, sf, "orders")).withColumnRenamed("window_", "window")
    found = clocks.reference_clocks(dates.parse(of(CLOCKS)), of(WINDOWS))
    return found.withColumn("instant", F.date_format("instant", "yyyy-MM-dd HH:mm:ss"))


#: Windows of the pictures: the calendar's, one over some of its cells in every second picture, one beside it without a place in every fifth.
FRAMES = f"""SELECT image, w AS window_, CASE WHEN w = 3 AND image % 5 = 0 THEN CAST(NULL AS INT) ELSE 3 - w END AS stack, CASE w WHEN 1 THEN 40 WHEN 2 THEN 350 + 10 * (image % 9) ELSE 900 END AS x,
  CASE w WHEN 1 THEN 20 WHEN 2 THEN 280 ELSE 0 END AS y, CASE w WHEN 1 THEN 820 WHEN 2 THEN 200 ELSE 400 END AS w, CASE w WHEN 1 THEN 760 WHEN 2 THEN 160 ELSE 300 END AS h
  FROM ({PICTURES}) p CROSS JOIN (SELECT 1 AS w UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE w <> 2 OR image % 2 = 0"""


@query(rf"""WITH {CELLS}, frames AS ({spoken(FRAMES, False)}),
ys AS (SELECT image, mid_y, mid_y - lag(mid_y) OVER (PARTITION BY image ORDER BY mid_y) AS gap FROM (SELECT DISTINCT image, mid_y FROM cells)),
high AS (SELECT image, min(mid_y) AS top, max(mid_y) AS bottom, {MEDIAN.format("gap")} AS gap FROM ys GROUP BY 1),
reg AS (SELECT c.image, min(mid_x) - any_value(width) / 2 AS x1, max(mid_x) + any_value(width) / 2 AS x2, any_value(top - 0.2::DOUBLE * coalesce(gap, 0.6::DOUBLE * width)) AS y1, any_value(bottom + coalesce(gap, 0.6::DOUBLE * width)) AS y2,
  arg_min(mid_x, k) AS ax, arg_min(mid_y, k) AS ay FROM cells c JOIN high ON high.image = c.image GROUP BY c.image),
own AS (SELECT r.image, min(stack) AS stack FROM reg r JOIN frames f ON f.image = r.image AND ax BETWEEN f.x AND f.x + f.w AND ay BETWEEN f.y AND f.y + f.h WHERE r.image NOT IN (SELECT image FROM frames WHERE stack IS NULL) GROUP BY 1)
SELECT l.image, l.n FROM lines l LEFT JOIN reg r ON r.image = l.image WHERE r.image IS NULL OR (l.x + l.w / 2 BETWEEN x1 AND x2 AND l.y + l.h / 2 BETWEEN y1 AND y2
  AND NOT EXISTS (SELECT 1 FROM frames f JOIN own ON own.image = f.image AND f.stack < own.stack WHERE f.image = l.image AND l.x + l.w / 2 BETWEEN f.x AND f.x + f.w AND l.y + l.h / 2 BETWEEN f.y AND f.y + f.h))""")
def subject_lines(spark, sf):
    """The lines of month views that are inside the grid and that no window in front covers."""
    lines = _lines(spark, sf)
    regions = G.month_regions(G.month_cells(lines, _pictures(spark, sf)))
    frames = spark.sql(spoken(FRAMES, True).replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return G.subject_lines(lines, regions, frames).select("image", "n")
