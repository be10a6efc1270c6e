"""Evaluation beyond matching: fields, lines, disagreements, gates and reports over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, evaluation_similarity

TIMES = ("start", "end", "due", "remind")


def field_problems(want: Column, got: Column) -> Column:
    """Compared fields of a matched pair as (field, same), for structs of times in seconds, inferred, all_day, people, window, place.

    A time counts where either side has it, with its flag; all-day where either says so; people and place where either
    side has any; the window where one is expected.
    """
    note = lambda test, field, same: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(field).alias("field"), F.coalesce(same, F.lit(False)).alias("same")))
    flag = lambda side, t: F.coalesce(F.array_contains(side["inferred"], t), F.lit(False))
    low = lambda side: F.array_sort(F.array_distinct(F.transform(F.coalesce(side["people"], F.array().cast("array<string>")), F.lower)))
    place = lambda side: compact(F.coalesce(side["place"], F.lit("")))
    notes = []
    for t in TIMES:
        either = want[t].isNotNull() | got[t].isNotNull()
        notes += [note(either, t, F.abs(want[t] - got[t]) < 1), note(either, f"{t} flag", flag(want, t) == flag(got, t))]
    day = lambda side: F.coalesce(side["all_day"], F.lit(False))
    notes.append(note(want["all_day"].isNotNull() | day(got), "all day", day(want) == day(got)))
    notes.append(note((F.size(low(want)) > 0) | (F.size(low(got)) > 0), "people", low(want) == low(got)))
    notes.append(note(want["window"].isNotNull(), "window", want["window"].eqNullSafe(got["window"])))
    notes.append(note((place(want) != "") | (place(got) != ""), "place", place(want) == place(got)))
    return F.array_compact(F.array(*notes))


def line_scores(want: DataFrame, got: DataFrame) -> DataFrame:
    """(case, exact, expected, overlap, boxed) of (case, n, text, box) lines; boxes are structs x, y, w, h or null.

    A line is read if some line of the case equals it without blanks and with one kind of dash, or holds it where it has
    four letters or more. Equal texts meet by the text; only the others are looked for inside longer lines of the case.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "[‐-―−]", "-"), r"\s", "")
    a = want.select("case", "n", plain(F.col("text")).alias("t"), F.col("box").alias("wb"))
    b = got.select("case", plain(F.col("text")).alias("u"), F.col("box").alias("gb"))
    area = lambda x: x["w"] * x["h"]
    side = lambda lo, size: F.greatest(F.lit(0), F.least(F.col("wb")[lo] + F.col("wb")[size], F.col("gb")[lo] + F.col("gb")[size]) - F.greatest(F.col("wb")[lo], F.col("gb")[lo]))
    over = side("x", "w") * side("y", "h") * 2 >= F.least(area(F.col("wb")), area(F.col("gb")))
    same = a.join(b.withColumnRenamed("u", "t"), ["case", "t"]).select("case", "n", F.coalesce(over, F.lit(False)).alias("over"))
    rest = a.where(F.length("t") >= 4).join(same.select("case", "n").distinct(), ["case", "n"], "left_anti")
    longer = rest.join(b, "case").where((F.length("u") > F.length("t")) & F.col("u").contains(F.col("t"))).select("case", "n", F.coalesce(over, F.lit(False)).alias("over"))
    read = same.unionByName(longer).groupBy("case", "n").agg(F.bool_or("over").alias("over"))
    every = a.join(read.withColumn("read", F.lit(True)), ["case", "n"], "left")
    boxed = F.col("wb").isNotNull() & F.col("read")
    count = lambda c: F.count(F.when(c, 1))
    return every.groupBy("case").agg(count(F.col("read")).alias("exact"), F.count("*").alias("expected"), count(boxed & F.col("over")).alias("overlap"), count(boxed).alias("boxed"))


def disagrees(title: Column, cited: Column) -> Column:
    """Whether a finding's title is neither in its cited text nor the other way round."""
    t, c = compact(title), compact(cited)
    return F.coalesce((cited != "") & (t != "") & ~c.contains(t) & ~t.contains(c), F.lit(False))


def closest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, found, expected): the expected title most like each unmatched one of its case, the first of equals."""
    e = expected.select("case", F.col("id").alias("expected"), F.col("title").alias("_t"))
    near = found.select("case", F.col("id").alias("found"), "title").join(e, "case")
    score = F.struct(evaluation_similarity(compact(F.col("title")), compact(F.col("_t"))).alias("s"), (-F.col("expected")).alias("e"))
    return near.groupBy("case", "found").agg(F.max_by("expected", score).alias("expected"))


def gates(numbers: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """(gate, value, passed) of one row of numbers against their limits; a missing number fails."""
    tests = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.coalesce(F.col(k) >= v, F.lit(False)).alias("passed")) for k, v in least.items()]
    tests += [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.coalesce(F.col(k) <= v, F.lit(False)).alias("passed")) for k, v in most.items()]
    return numbers.select(F.explode(F.array(*tests)).alias("g")).select("g.*")


def reanalysed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(case, before, after, fresh): items of (case, item) rows of two passes over the same pictures; none may be fresh."""
    a, b = first.select("case", "item").distinct().withColumn("_a", F.lit(1)), second.select("case", "item").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, ["case", "item"], "full_outer")
    return both.groupBy("case").agg(F.count("_a").alias("before"), F.count("_b").alias("after"), F.count(F.when(F.col("_a").isNull(), 1)).alias("fresh"))


def compared_sequences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(case, merged, wrong, items): differences of two reports' (case, merged, wrong, items) where anything changed; null: only one has it."""
    left, right = (x.select("case", *[F.col(c).alias(f"{c}{k}") for c in ("merged", "wrong", "items")]) for k, x in ((1, a), (2, b)))
    both = left.join(right, "case", "full_outer").select("case", *[(F.col(f"{c}2") - F.col(f"{c}1")).alias(c) for c in ("merged", "wrong", "items")])
    return both.where(F.coalesce(F.abs("merged") + F.abs("wrong") + F.abs("items"), F.lit(1)) > 0)


def contradicted(absent: DataFrame, seen: DataFrame, images: DataFrame) -> DataFrame:
    """Absences (item, image) left after the re-read ``images``: those that their sightings now contradict are gone, none is added."""
    denied = seen.join(images.select("image").distinct(), "image", "left_semi").select("item", "image").distinct()
    return absent.join(denied, ["item", "image"], "left_anti")


def suspicion(absent: DataFrame, seen: DataFrame) -> DataFrame:
    """(item, last_seen, absences): when an item was last seen, and the pictures after that which no longer show it, newest first."""
    last = seen.groupBy("item").agg(F.max("at").alias("last_seen"))
    since = absent.join(last, "item").where(F.col("at") > F.col("last_seen"))
    listed = F.transform(F.sort_array(F.collect_set(F.struct("at", "image")), asc=False), lambda x: x["image"])
    return since.groupBy("item", "last_seen").agg(listed.alias("absences"))


def distinct_contexts(cases: DataFrame) -> DataFrame:
    """(name, zone): contexts of (case, name, zone) rows by name, the first case's zone wins."""
    first = Window.partitionBy("name").orderBy("case")
    return cases.where("name is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("name", "zone")
