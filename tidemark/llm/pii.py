"""Personal data: base patterns, and identifiers that the contexts of known ones give away.

Bootstrapped contextual extraction. Base matches are the seeds. A text is read as units: words, and candidates, which
hold a digit or one of ``@ _ [ ( {``. Every unit stands in four contexts, lexical patterns of the words beside it: one, two or three
units before it, and one before with one after. A pattern's fillers are the distinct candidates and the distinct
ordinary words that are found in it anywhere in the corpus.

Patterns and instances score each other for ``ROUNDS`` rounds. A seed has score 1. A pattern's score is the sum of its candidates'
scores over the number of all its fillers; ordinary words count as nought. A candidate's score is the mean over the distinct
places (all four contexts) that it is met in of the best pattern's score there. A pattern whose score is ``ACCEPT`` or
more, with a sum of ``SUPPORT`` or more, is accepted: every candidate in it is a span of the kind most of its seeds have,
unless it overlaps a base span. Distinct fillers count, so copies of a text teach no more than one.

Each table here grows with the corpus and is shuffled by its own keys; only patterns are broadcast, ``SENT_ROWS`` at a
time. The number of distinct ordinary words of a pattern is estimated (HyperLogLog, 5 %), which merges map-side.

Base matches per kind are leftmost and do not overlap; positions are code points. The expressions are the contract's, written so
that no text takes more than linear time: a run is entered at its start only and never given back.

Defined results: null and empty texts have no spans; a text's repeated rows get equal spans; texts of any length are
read whole, position sums in two levels; without seeds nothing is added; an empty table has no rows. Columns ``spans``
and ``found`` are replaced, all others passed on. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, looked_up, sent_if_small, settled, text_key

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ACCEPT, LEAST, ROUNDS = 3, 0.6, 0.05, 4
RUN = 256
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"

_HOST = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_DOTTED = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PLUS = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The base patterns; a match can begin in the middle of a run of its letters only where another match has ended.
BASE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{_HOST}",
    "ip": rf"(?<![0-9]){_DOTTED}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": _PLUS,
}
_ALNUM, _JOINS = r"[\p{L}\p{M}\p{N}]", r"[._@%+#\[\](){}-]"
#: A word followed by a space or a mark; a phone, mail or net address, numbers in groups; anything else joined without a space.
UNIT = "|".join([
    r"\p{L}++(?=[\s,;:!?])", _PLUS, rf"[A-Za-z0-9][A-Za-z0-9._%+-]*+{_HOST}", _DOTTED, r"\([0-9]++\)[ -]?[0-9](?:[ .-]?[0-9])++",
    rf"[0-9]++[\p{{L}}\p{{M}}]{_ALNUM}*+(?:{_JOINS}++{_ALNUM}++)*+", r"[0-9](?:[ -]?[0-9])++", rf"{_ALNUM}++(?:{_JOINS}++{_ALNUM}++)*+",
])
CANDIDATE = r"[0-9@_\[({]"
PATTERNS = ("l1", "l2", "l3", "lr")


def _let(value: Column, use) -> Column:
    """``use`` of the value, which is computed once."""
    return F.transform(F.array(value), use)[0]


def _runs(values: Column) -> Column:
    last = F.floor((F.size(values) - 1) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))


def _before(values: Column, merge) -> Column:
    """For each of an array's longs, those before it and 0 merged: over the runs before its own, then inside its run."""
    start = F.lit(0).cast("long")

    def inside(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, start, merge))
        heads = _let(totals, lambda all_: F.transform(all_, lambda _, k: F.aggregate(F.slice(all_, F.lit(1), k), start, merge)))
        each = lambda run, head: F.transform(run, lambda _, i: F.aggregate(F.slice(run, F.lit(1), i), head, merge))
        return _let(heads, lambda known: F.flatten(F.transform(runs, lambda run, k: each(run, known[k]))))

    return F.when(F.size(values) > 0, _let(_runs(values), inside)).otherwise(F.array().cast("array<bigint>"))


def _located(text: Column, pattern: str, found: Column) -> Column:
    """Start and end of each of ``found``, the pattern's matches in the text: lengths of matches and of what is between them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    sizes = F.transform(found, lambda m: F.length(m).cast("long"))

    def placed(gaps: Column, sizes: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda a, b: a + b)
        starts = F.zip_with(_before(steps, lambda a, b: a + b), F.slice(gaps, F.lit(1), F.size(sizes)), lambda a, b: a + b)
        return F.zip_with(starts, sizes, lambda a, n: F.struct(a.alias("start"), (a + n).alias("end")))

    return _let(gaps, lambda g: _let(sizes, lambda s: placed(g, s)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        x = F.substring(digits, -k, 1).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """What a kind's matches have to fulfil besides the pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
        return F.forall(F.split(match, r"\."), small)
    n = F.length(_digits(match))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind, then start."""
    text = F.coalesce(text, F.lit(""))

    def spans(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(BASE[kind]), 0)

        def kept(found: Column) -> Column:
            met = F.zip_with(found, _located(text, BASE[kind], found), lambda m, s: F.struct(m.alias("m"), s["start"].alias("start"), s["end"].alias("end")))
            good = F.filter(met, lambda x: _valid(kind, x["m"]))
            return F.transform(good, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPAN)

        return _let(found, lambda f: F.when(F.size(f) > 0, kept(f)).otherwise(F.array().cast(SPAN)))

    return F.concat(*[spans(kind) for kind in KINDS])


def _seed_kind(unit: Column) -> Column:
    """Number of the kind that the whole unit is a base match of, else null."""
    forms = {"email": rf"^[A-Za-z0-9._%+-]+{_HOST}$", "ip": rf"^{_DOTTED}$", "card": r"^[0-9](?:[ -]?[0-9])++$", "phone": rf"^{_PLUS}$"}
    return F.coalesce(*[F.when(unit.rlike(forms[k]) & _valid(k, unit), F.lit(n)) for n, k in enumerate(KINDS)])


def _units(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """A row for each unit: itself, three units before it, one after it, and its number in the text."""
    pad = lambda n: F.concat(F.array(*[F.lit("")] * n), F.col("_u"))
    told = docs.select(*keep, F.regexp_extract_all(text, F.lit(UNIT), 0).alias("_u")).where(F.size("_u") > 0)
    zipped = F.arrays_zip(F.col("_u").alias("x"), pad(1).alias("a1"), pad(2).alias("a2"), pad(3).alias("a3"), F.slice("_u", 2, 2147483647).alias("b1"))
    rows = told.select(*keep, F.posexplode(zipped).alias("ord", "z")).select(*keep, "ord", "z.*")
    return rows.where(F.col("x").isNotNull())


def _contexts() -> list[Column]:
    """The patterns that a unit stands in, hashed."""
    a1, a2, a3, b1 = (F.lower(F.coalesce(c, F.lit(""))) for c in ("a1", "a2", "a3", "b1"))
    parts = {"l1": (a1,), "l2": (a2, a1), "l3": (a3, a2, a1), "lr": (a1, b1)}
    return [F.xxhash64(F.lit(p), *parts[p]).alias(p) for p in PATTERNS]


def _row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), text_key(F.col("text")).alias("_key")]


def candidates(docs: DataFrame) -> DataFrame:
    """(_id, _key, ord, v, kind, patterns): every place of a candidate; ``v`` is its hash, ``kind`` a seed's, else null."""
    rows = _units(docs.select(*_row_key(), "text"), F.coalesce("text", F.lit("")), "_id", "_key")
    some = rows.where(F.col("x").rlike(CANDIDATE))
    return some.select("_id", "_key", "ord", F.xxhash64(F.lower("x")).alias("v"), _seed_kind(F.col("x")).alias("kind"), *_contexts())


def _fillers(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (v, kind, patterns) places, and (h, v, kind) for the patterns that can be learned: with enough candidates, one of them a seed."""
    spots = settled(places.groupBy("v", *PATTERNS).agg(F.min("kind").alias("kind")))
    pairs = spots.select("v", "kind", F.explode(F.array(*PATTERNS)).alias("h")).groupBy("h", "v").agg(F.min("kind").alias("kind"))
    return spots, settled(pairs)


def _learnable(pairs: DataFrame) -> DataFrame:
    """(h, n, seeds, kind): patterns with ``SUPPORT`` candidates and a seed; the kind most of their seeds have, ties by the kinds' order."""
    of = [F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in range(len(KINDS))]
    told = pairs.groupBy("h").agg(F.count("*").alias("n"), F.count("kind").alias("seeds"), *of).where((F.col("n") >= SUPPORT) & (F.col("seeds") > 0))
    most = F.greatest(*[F.col(f"k{k}") for k in range(len(KINDS))])
    return told.select("h", "n", "seeds", F.coalesce(*[F.when(F.col(f"k{k}") == most, F.lit(k)) for k in range(len(KINDS))]).alias("kind"))


def _ordinary(docs: DataFrame, learnable: DataFrame) -> DataFrame:
    """(h, words): about how many distinct words that are no candidates fill each pattern, in passes of ``SENT_ROWS`` patterns."""
    words = _units(docs.select(F.lower("text").alias("text")), F.col("text"))
    rows = words.where(~F.col("x").rlike(CANDIDATE)).select(F.xxhash64("x").alias("x"), F.explode(F.array(*_contexts())).alias("h"))
    parts = max(1, -(-learnable.count() // SENT_ROWS))
    some = lambda k: learnable.where(F.pmod("h", F.lit(parts)) == k).select("h")
    counted = [rows.join(F.broadcast(some(k)), "h").groupBy("h").agg(F.approx_count_distinct("x").alias("words")) for k in range(parts)]
    return reduce(DataFrame.unionByName, counted)


def learn(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(h, score, kind): the accepted patterns. ``places`` are the kept candidates of ``docs``."""
    spots, pairs = _fillers(places)
    learnable = settled(_learnable(pairs))
    known = learnable.join(_ordinary(docs, learnable), "h", "left")
    known = settled(known.select("h", "kind", "seeds", "n", (F.col("n") + F.coalesce("words", F.lit(0))).alias("fillers")))
    near = lambda rows, *keep: looked_up(rows, known.select("h", "n", F.lit(True).alias("_known")), "h").where("_known").select(*keep)
    place = F.xxhash64(*PATTERNS).alias("place")
    open_ = spots.where(F.col("kind").isNull())
    total = open_.groupBy("v").agg(F.count("*").alias("places"))
    apart = settled(near(open_.select("v", place, F.explode(F.array(*PATTERNS)).alias("h")), "v", "place", "h"))
    unseen = settled(near(pairs.where(F.col("kind").isNull()).select("h", "v"), "h", "v"))

    scored = settled(_scored(known.withColumn("more", F.lit(0.0))))
    for _ in range(ROUNDS):
        telling = settled(scored.where((F.col("mass") >= SUPPORT) & (F.col("score") >= LEAST)).select("h", "score", "n"))
        if not telling.head(1):
            break  # no candidate's score can move any more
        best = looked_up(apart, telling, "h").where(F.col("score").isNotNull()).groupBy("v", "place").agg(F.max("score").alias("score"))
        found = best.groupBy("v").agg(F.sum("score").alias("score")).join(total, "v").select("v", (F.col("score") / F.col("places")).alias("own"))
        met = settled(found.join(unseen.groupBy("v").agg(F.count("*").alias("n")), "v"))
        more = looked_up(unseen, met, "v").groupBy("h").agg(F.sum("own").alias("more"))
        scored = settled(_scored(known.join(more, "h", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))))
    return settled(scored.where((F.col("mass") >= SUPPORT) & (F.col("score") >= ACCEPT)).select("h", "score", "kind", "n"))


def _scored(known: DataFrame) -> DataFrame:
    mass = F.col("seeds") + F.col("more")
    return known.withColumn("mass", mass).withColumn("score", F.round(mass / F.col("fillers"), 9))


def hits(places: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_id, _key, found): the units of each text, by number, that an accepted pattern tells of, with their kinds."""
    rows = places.where(F.col("kind").isNull()).select("_id", "_key", "ord", F.explode(F.array(*PATTERNS)).alias("h"))
    told = looked_up(rows, patterns, "h").where(F.col("score").isNotNull())
    best = told.groupBy("_id", "_key", "ord").agg(F.max(F.struct("score", (-F.col("kind")).alias("last"))).alias("b"))
    unit = F.struct("ord", (-F.col("b.last")).alias("kind"))
    return best.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(unit)).alias("found"))


def _overlaps(runs: Column, x: Column) -> Column:
    """Whether a span meets one of the spans in runs, which have their least start and greatest end."""
    meets = lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])
    return F.exists(runs, lambda r: meets(r) & F.exists(r["spans"], meets))


def _added(text: Column, found: Column, base: Column) -> Column:
    """The spans of found units, without those that overlap base spans."""

    def kept(places: Column, runs: Column) -> Column:
        spans = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), places[x["ord"]]["start"].alias("start"), places[x["ord"]]["end"].alias("end")))
        return F.filter(spans, lambda x: ~_overlaps(runs, x)).cast(SPAN)

    ends = lambda run: F.struct(F.array_min(run["start"]).alias("start"), F.array_max(run["end"]).alias("end"), run.alias("spans"))
    runs = F.when(F.size(base) > 0, F.transform(_runs(base), ends)).otherwise(F.slice(F.array(ends(F.array().cast(SPAN))), 1, 0))
    units = F.regexp_extract_all(text, F.lit(UNIT), 0)
    return _let(units, lambda u: _let(_located(text, UNIT, u), lambda places: _let(runs, lambda r: kept(places, r))))


def personal_data(docs: DataFrame) -> DataFrame:
    """Adds ``found`` (the base spans) and ``spans`` (those and what the learned patterns add) to rows with doc_id and text.

    Both are by kind, then start; a span is a kind's number in ``KINDS``, its start and its end.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("found", "spans")])
    own = docs.select("doc_id", "text")
    places = settled(candidates(own))
    heard = settled(hits(places, learn(own, places))).select(F.col("_id").alias("_h_id"), F.col("_key").alias("_h_key"), F.col("found").alias("_h_found"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    key = dict(zip(("_id", "_key"), _row_key(), strict=True))
    met = whole.join(sent_if_small(heard), (F.col("_h_id") == key["_id"]) & (F.col("_h_key") == key["_key"]), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    based = met.select("_row", "text", "_h_found", base_spans(F.col("text")).alias("_base"))
    both = F.when(F.col("_h_found").isNotNull(), F.array_sort(F.concat("_base", _added(text, F.col("_h_found"), F.col("_base"))))).otherwise(F.col("_base"))
    told = based.select("_row", F.struct(F.col("_base").alias("found"), both.alias("spans")).alias("_told"))
    return told.select("_row.*", "_told.*")


def number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that meet are covered whole, under the first one's kind."""
    laid = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def pieces(laid: Column, before: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            gap = F.substring(text, (before[k] + 1).cast("int"), F.greatest(x["start"] - before[k], F.lit(0)).cast("int"))
            return F.when(x["start"] < before[k], "").otherwise(F.concat(gap, names[x["kind"]]))

        return F.transform(laid, piece)

    def whole(laid: Column) -> Column:
        before = _before(F.transform(laid, lambda x: -x["end"]), lambda a, b: F.greatest(a, b))
        last = F.array_max(F.transform(laid, lambda x: -x["end"]))
        return F.concat(_let(before, lambda b: F.array_join(pieces(laid, b), "")), F.substring(text, (last + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, _let(laid, whole)).otherwise(text)
