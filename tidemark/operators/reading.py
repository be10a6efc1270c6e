"""What a model said of a picture: validation, classification, tags, windows and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..sources.folders import settled

#: Kinds of findings and screens, tag values that say nothing, and system windows' names.
KINDS = ("appointment", "task", "reminder", "deadline")
SCREENS = ("calendar_week", "calendar_month", "calendar_day", "email", "chat", "document", "other")
NOTHING = ("", "unknown", "none", "n/a", "na")
SYSTEM_BUNDLES, SYSTEM_NAMES = ("com.apple.dock", "com.apple.controlcenter", "com.apple.notificationcenterui", "com.apple.windowmanager"), ("window server",)

DRAFT = "struct<kind:string,title:string,start:string,end:string,due:string,place:string,people:array<string>,lines:array<string>>"


def draft(answer: Column) -> Column:
    """A finding from its JSON text; null if it is none, its kind is unknown, its title is empty or a citation is no whole number."""
    d = F.from_json(answer, DRAFT)
    whole = F.forall(F.coalesce(d["lines"], F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike("^-?[0-9]+$"), F.lit(False)))
    return F.when(d["kind"].isin(*KINDS) & (F.trim(F.coalesce(d["title"], F.lit(""))) != "") & whole, d)


def schema_problem(value: Column, schema: dict, at: str = "$") -> Column:
    """The path and kind of the first place where a variant breaks a JSON schema; null if it keeps it.

    Known: type, required, enum, minItems, maxItems, minLength, additionalProperties false, properties, and items of
    plain values. A schema is known when the plan is made, so its rules unfold into columns.
    """
    found = F.schema_of_variant(value)
    kinds = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
    is_kind = found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") if schema.get("type") == "number" else found.startswith(kinds.get(schema.get("type", ""), ""))
    rules = [F.when(value.isNull() | ~is_kind, F.lit(f"{at}: type"))]
    if "enum" in schema:
        rules.append(F.when(~F.coalesce(F.try_variant_get(value, "$", "string").isin(*map(str, schema["enum"])), F.lit(False)), F.lit(f"{at}: enum")))
    if "minLength" in schema:
        rules.append(F.when(F.length(F.try_variant_get(value, "$", "string")) < schema["minLength"], F.lit(f"{at}: minLength")))
    if schema.get("type") == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        if "minItems" in schema:
            rules.append(F.when(F.size(items) < schema["minItems"], F.lit(f"{at}: minItems")))
        if "maxItems" in schema:
            rules.append(F.when(F.size(items) > schema["maxItems"], F.lit(f"{at}: maxItems")))
        if "items" in schema:
            told = F.transform(items, lambda x, k: F.when(_broken(x, schema["items"]), F.concat(F.lit(f"{at}["), k.cast("string"), F.lit("]: items"))))
            rules.append(F.get(F.array_compact(told), 0))
    if schema.get("type") == "object":
        names = F.json_object_keys(F.to_json(value))
        for name in schema.get("required", ()):
            rules.append(F.when(~F.coalesce(F.array_contains(names, name), F.lit(False)), F.lit(f"{at}.{name}: required")))
        if schema.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(names, F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")))
            rules.append(F.when(F.size(extra) > 0, F.concat(F.lit(f"{at}."), F.get(extra, 0), F.lit(": additionalProperties"))))
        for name, inner in schema.get("properties", {}).items():
            rules.append(F.when(F.array_contains(names, name), schema_problem(F.try_variant_get(value, f"$.{name}", "variant"), inner, f"{at}.{name}")))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def _broken(value: Column, schema: dict) -> Column:
    return schema_problem(value, schema).isNotNull()


def resolved_kind(kind: Column, confidence: Column, least: float = 0.5) -> Column:
    """A classification that is sure enough and known, else other."""
    return F.when(kind.isin(*SCREENS) & (confidence >= least), kind).otherwise("other")


def corrected_kind(kind: Column, headers: Column, headers_span: Column, cells: Column, cells_span: Column) -> Column:
    """With three day headers or more, a day is a week, and a month too unless its cells span two thirds of the headers."""
    wide = (cells == 0) | (headers_span > 1.5 * cells_span)
    return F.when((headers >= 3) & ((kind == "calendar_day") | ((kind == "calendar_month") & wide)), "calendar_week").otherwise(kind)


def tags_of(tags: DataFrame, key: str) -> DataFrame:
    """(key, name, value, confidence) tags that say something, the first of each name and value, by ``n``."""
    said = tags.where(~F.lower(F.trim("value")).isin(*NOTHING))
    first = Window.partitionBy(key, "name", "value").orderBy("n")
    return said.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(key, "name", "value", "confidence")


def doubted(key: Column, value: Column, confidence: Column, apps: Column, remote: Column, lines: Column, most: float = 0.4) -> Column:
    """A tag's confidence, at most ``most`` where the windows contradict it; without windows nothing does.

    apps: names and bundles of the windows; remote: whether one is a remote client; lines: the texts read. An application
    has to be named by a window or a line, a remote session needs a client, and another platform no system window.
    """
    low = F.lower(value)
    named = F.exists(apps, lambda a: F.lower(a).contains(low) | low.contains(F.lower(a))) | F.exists(lines, lambda x: F.lower(x).contains(low))
    own = F.exists(apps, lambda a: F.lower(a).startswith("com.apple."))
    wrong = F.when(key == "application", ~named).when(key == "remote_session", ~remote).when(key == "platform_look", (low != "macos") & own).otherwise(False)
    return F.when((F.size(apps) > 0) & wrong, F.least(confidence, F.lit(most))).otherwise(confidence)


def zone_of(context_zone: Column, machine_zone: Column, known: Column) -> Column:
    """(zone, source): the context's zone, else the machine's; one that is not among the ``known`` is told, not hidden."""
    fits = F.array_contains(known, context_zone)
    source = F.when(context_zone.isNull(), "machine").when(fits, "context").otherwise("invalid-context-zone")
    return F.struct(F.when(context_zone.isNotNull() & fits, context_zone).otherwise(machine_zone).alias("zone"), source.alias("source"))


def merged_repeats(drafts: DataFrame) -> DataFrame:
    """(image, title, n, start, end, due, place) drafts with the same normalised title and a cited line in common as one.

    The first keeps its place and gets what it lacks from the next ones. Drafts meet by (image, title, line), and a
    draft's group is its first draft over all its lines. Every step is by picture, so drafts that are dealt by picture stay where they are.
    """
    keyed = drafts.withColumn("_t", normalise(F.col("title"))).where("image is not null and _t is not null and n is not null")
    cited = keyed.select("image", "_t", "n", "title", "start", "end", "due", "place", F.explode_outer("lines").alias("_l"))
    first = F.min("n").over(Window.partitionBy("image", "_t", "_l"))
    met = cited.withColumn("_f", F.when(F.col("_l").isNull(), F.col("n")).otherwise(first)).withColumn("_f", F.min("_f").over(Window.partitionBy("image", "_t", "n")))
    fill = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    grouped = met.groupBy("image", "_f").agg(F.min_by("title", "n").alias("title"), *[fill(c) for c in ("start", "end", "due", "place")])
    return grouped.select("image", F.col("_f").alias("n"), "title", "start", "end", "due", "place")


def windows_problem(given: Column, named: Column) -> Column:
    """An answer on windows must name exactly the given keys, each once: what is wrong, or null."""
    return (
        F.when(F.size(F.array_except(named, given)) > 0, "unknown window").when(F.size(named) != F.size(F.array_distinct(named)), "window named twice")
        .when(F.size(F.array_except(given, named)) > 0, "window left out")
    )


def kind_from_windows(windows: DataFrame) -> DataFrame:
    """(image, kind): of the frontmost relevant window that has one, else other; (image, stack, relevant, kind, chosen), where a chosen window is relevant."""
    fits = (F.col("relevant") | F.col("chosen")) & F.col("kind").isNotNull() & (F.col("kind") != "other")
    return windows.groupBy("image").agg(F.coalesce(F.min_by("kind", F.when(fits, F.col("stack"))), F.lit("other")).alias("kind"))


def end_is_shown(end: Column, cited: Column) -> Column:
    """Whether an end's text stands, blanks aside, in a cited line that is more than a clock."""
    bare = F.regexp_replace(end, r"\s", "")
    return F.coalesce((bare != "") & F.exists(cited, lambda x: ~x.rlike(r"^\s*\d{1,2}[:.]\d{2}\s*$") & F.regexp_replace(x, r"\s", "").contains(bare)), F.lit(False))


def title_line(lines: DataFrame) -> DataFrame:
    """(finding, line): the cited line with the start's text, else with the title, else the topmost; (finding, line, y, text, title, start)."""
    rank = F.when(F.col("text").contains(F.col("start")), 0).when(F.lower("text").contains(F.lower("title")), 1).otherwise(2)
    return lines.groupBy("finding").agg(F.min_by("line", F.struct(rank, "y", "line")).alias("line"))


def assembled(start: Column, end: Column, due: Column, kind: Column, end_shown: Column, midnight: Column, minutes: int = 60) -> Column:
    """(start, end, due) of a finding in seconds: an end only if shown and after the start, else an hour, but not past midnight.

    Deadlines and tasks have a due time, from the start if they lack one, and no span.
    """
    event = kind == "appointment"
    usual = F.least(start + minutes * 60, midnight)
    stop = F.when(event & start.isNotNull(), F.when(end_shown & (end > start), end).otherwise(usual))
    return F.struct(F.when(event, start).alias("start"), stop.alias("end"), F.when(~event, F.coalesce(due, start)).alias("due"))


def locale_order(locales: Column, language: Column) -> Column:
    """The locales with those of the detected language moved to the front."""
    fits = lambda x: F.coalesce(x.startswith(language), F.lit(False))
    return F.concat(F.filter(locales, fits), F.filter(locales, lambda x: ~fits(x)))


def as_appointment(kind: Column, screen: Column) -> Column:
    """Calendar views hold appointments only."""
    return F.when(screen.startswith("calendar_"), "appointment").otherwise(kind)


def yes_probability(first_yes: Column, first_no: Column, second_yes: Column, second_no: Column) -> Column:
    """The smaller share of yes from the log-probabilities of both orders of a pair."""
    share = lambda yes, no: F.exp(yes) / (F.exp(yes) + F.exp(no))
    return F.least(share(first_yes, first_no), share(second_yes, second_no))


def judged_candidates(scored: DataFrame, most: int = 2) -> DataFrame:
    """Uncertain candidates of dated findings that a judge is asked about: the best ``most`` of each (finding, item, combined, seen, undated, decision)."""
    best = Window.partitionBy("finding").orderBy(F.col("combined").desc(), F.col("seen").desc(), "item")
    return scored.where((F.col("decision") == "uncertain:") & ~F.col("undated")).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")


def is_system(app: Column, bundle: Column, own: str | None = None) -> Column:
    """Whether a window belongs to the system's own surfaces, or to the program named ``own``."""
    names, bundles = (list(x) + ([own] if own else []) for x in (SYSTEM_NAMES, SYSTEM_BUNDLES))
    return F.coalesce(F.lower(app).isin(*names), F.lit(False)) | F.coalesce(F.lower(bundle).isin(*bundles), F.lit(False))


#: Letters of a sensitive string that are looked up (longer ones: their last), and letters of a text that are cut at a time.
KEYED, CUT = 64, 1_000


def loggable(lines: DataFrame, text: str, sensitive: DataFrame, string: str, words: int = 12, most: int = 1_000) -> DataFrame:
    """Lines of at most ``words`` words that hold no sensitive string, whatever its case.

    Up to ``most`` strings become one pattern, so lines are read once and stay where they are. More of them are looked up among the
    runs of letters of the distinct words, or of the distinct lines if they have blanks: a run meets a string only if it is that string,
    so strings that begin alike make no pairs; the same lines are left at every size.
    Both grow with the text and pack well, so that a table of them looks small enough to be sent: these joins shuffle.
    """
    short = lines.where(F.size(F.split(text, " ")) <= words)
    strings = settled(sensitive.select(F.lower(string).alias("s")).where(F.length("s") > 0).distinct())
    few = [r["s"] for r in strings.limit(most + 1).collect()]
    if len(few) <= most:
        return short.where(~F.lower(text).rlike("|".join(map(_literal, sorted(few))))) if few else short
    low, blank = F.lower(text), F.col("s").contains(" ")
    lines_of = short.select(*_names(low, "line"), low.alias("_low"))
    each = lines_of.select("line_a", "line_b", F.explode(F.split("_low", " ")).alias("_w"))
    bad = _holding(each.select("_w").distinct(), "_w", strings.where(~blank)).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"))
    bad = each.select("line_a", "line_b", *_names(F.col("_w"), "word")).join(bad.hint("merge"), ["word_a", "word_b"], "left_semi").select("line_a", "line_b")
    if strings.where(blank).take(1):
        bad = bad.union(_holding(lines_of.select("_low").distinct(), "_low", strings.where(blank)))
    named = short.select(*[F.col(c) for c in short.columns], *_names(low, "_line"))
    same = (F.col("_line_a") == F.col("line_a")) & (F.col("_line_b") == F.col("line_b"))
    return named.join(bad.distinct().hint("merge"), same, "left_anti").select(*short.columns)


def _names(text: Column, of: str) -> list[Column]:
    """128 bits that tell a text from others."""
    return [F.xxhash64(text).alias(f"{of}_a"), F.xxhash64(F.lit("b"), text).alias(f"{of}_b")]


def _holding(texts: DataFrame, text: str, strings: DataFrame) -> DataFrame:
    """(a, b): names of the distinct texts that hold one of the strings ``s``.

    Texts are cut in pieces and these in runs of as many letters as strings have, up to ``KEYED``; of longer strings the last
    ``KEYED`` letters are met, and what meets is compared whole.
    """
    size = F.least(F.length("s"), F.lit(KEYED))
    sizes = sorted(r["n"] for r in strings.select(size.alias("n")).distinct().collect())  # at most KEYED numbers
    known = F.array(*[F.lit(n) for n in sizes]).cast("array<int>")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / CUT).cast("int")), lambda k: F.substring(text, k * CUT + 1, F.lit(CUT + KEYED - 1)))
    cut = texts.where(F.length(text) > 0).select(*_names(F.col(text), "t"), F.explode(pieces).alias("p"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("p"), F.lit(CUT))), lambda k: F.substring("p", k, F.lit(KEYED)))
    begun = cut.select("t_a", "t_b", F.explode(starts).alias("p"))
    run = lambda n: F.struct(*[c.alias(k) for c, k in zip(_names(F.substring("p", F.lit(1), n), "r"), ("x", "y"), strict=True)])
    runs = begun.select("t_a", "t_b", F.explode(F.transform(F.filter(known, lambda n: n <= F.length("p")), run)).alias("r")).select("t_a", "t_b", "r.x", "r.y")
    keyed = strings.withColumn("k", F.substring("s", -KEYED, KEYED)).select(*[c.alias(k) for c, k in zip(_names(F.col("k"), "k"), ("x", "y"), strict=True)], "s")
    whole = keyed.where(F.length("s") <= KEYED).select("x", "y")
    found = runs.join(whole.hint("merge"), ["x", "y"], "left_semi").select(F.col("t_a").alias("a"), F.col("t_b").alias("b"))
    if KEYED in sizes:
        long = keyed.where(F.length("s") > KEYED)
        met = runs.join(long.hint("merge"), ["x", "y"]).select(F.col("t_a").alias("a"), F.col("t_b").alias("b"), "s").distinct()
        named = texts.select(*_names(F.col(text), "n"), text)
        met = met.join(named.hint("merge"), (F.col("a") == F.col("n_a")) & (F.col("b") == F.col("n_b"))).where(F.col(text).contains(F.col("s")))
        found = found.union(met.select("a", "b"))
    return found.distinct()


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
