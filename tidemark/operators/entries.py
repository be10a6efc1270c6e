"""Entries in an outside calendar: rendering, edits made there, and the whole table of what a sync does.

Items have (item, family, title, context, place, people, start, end, due, remind, all_day, zone, status, needs_review);
times are seconds. An entry has (kind, title, start, end, due, alarm, all_day, location).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3_600, 86_400


def local_day(seconds: Column, zone: Column) -> Column:
    """The calendar day an instant falls on in a zone, as seconds of its midnight in UTC."""
    local = F.convert_timezone(F.lit("UTC"), zone, F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    return F.unix_date(local.cast("date")).cast("long") * DAY


def day_moment(day: Column, zone: Column) -> Column:
    """The reverse: the start of that day in the zone."""
    local = F.date_from_unix_date(F.floor(day / DAY).cast("int")).cast("timestamp_ntz")
    return F.unix_seconds(F.convert_timezone(zone, F.lit("UTC"), local).cast("timestamp"))


def entry_title(title: Column, context: Column) -> Column:
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", title).otherwise(F.concat(F.lit("["), context, F.lit("] "), title))


def rendered(items: DataFrame) -> DataFrame:
    """Adds ``entry``. An event without an end lasts an hour; all-day entries hold days, and an end only after the first day."""
    event, all_day = F.col("family") == "event", F.col("all_day")
    day = lambda c: local_day(F.col(c), F.col("zone"))
    start = F.when(event, F.when(all_day, day("start")).otherwise(F.col("start")))
    end = F.when(event & all_day, F.when(day("end") > day("start"), day("end"))).when(event, F.coalesce(F.col("end"), F.col("start") + HOUR))
    due = F.coalesce("due", "start")
    due = F.when(~event, F.when(all_day, local_day(due, F.col("zone"))).otherwise(due))
    entry = F.struct(
        F.when(event, "event").otherwise("reminder").alias("kind"), entry_title(F.col("title"), F.col("context")).alias("title"), start.alias("start"), end.alias("end"),
        due.alias("due"), F.when(~event, F.col("remind")).alias("alarm"), all_day.alias("all_day"), F.when(event & (F.col("place") != ""), F.col("place")).alias("location"),
    )
    return items.withColumn("entry", entry)


def entry_hash(entry: Column) -> Column:
    """Stable over all that is written."""
    return F.sha2(F.to_json(entry, {"ignoreNullFields": "true"}), 256)


def notes(item: Column, people: Column, place: Column, family: Column, lines: Column, most: int = 3) -> Column:
    """The text below an entry: who, where (for reminders), up to three lines of evidence, and the item's link."""
    parts = F.array(
        F.lit("Made from what was seen"), F.when(F.size(people) > 0, F.concat(F.lit("With: "), F.array_join(people, ", "))),
        F.when((family != "event") & (place != ""), F.concat(F.lit("Place: "), place)),
    )
    seen = F.transform(F.slice(lines, 1, most), lambda x: F.concat(F.lit("Seen: "), x))
    return F.array_join(F.concat(F.array_compact(parts), seen, F.array(F.concat(F.lit("item://"), item))), "\n")


def changed_fields(old: Column, new: Column) -> Column:
    """The names of fields in which two entries differ, times by a second or more."""
    time = lambda f: ~(old[f].eqNullSafe(new[f]) | F.coalesce(F.abs(old[f] - new[f]) < 1, F.lit(False)))
    place = lambda e: F.coalesce(e["location"], F.lit(""))
    tests = [("title", old["title"] != new["title"]), ("start", time("start")), ("end", time("end")), ("all day", old["all_day"] != new["all_day"]),
             ("place", place(old) != place(new)), ("due", time("due")), ("alarm", time("alarm"))]
    return F.array_compact(F.array(*[F.when(t, name) for name, t in tests]))


def outside_edits(last: Column, now: Column, context: Column, zone: Column) -> Column:
    """What a user changed in the calendar since the entry was written, as (field, value) of the item.

    The title loses the context's prefix, days become moments in the item's zone, notes and alarms are not taken.
    """
    prefix = F.concat(F.lit("["), context, F.lit("] "))
    bare = F.when(F.coalesce(context, F.lit("")) == "", now["title"]).when(now["title"].startswith(prefix), now["title"].substr(F.length(prefix) + 1, F.length(now["title"]))).otherwise(now["title"])
    moved = lambda f: now[f].isNotNull() & ~F.coalesce(F.abs(last[f] - now[f]) < 1, F.lit(False))
    moment = lambda f: F.when(now["all_day"], day_moment(now[f], zone)).otherwise(now[f]).cast("string")
    event, where = last["kind"] == "event", lambda e: F.coalesce(e["location"], F.lit(""))
    edit = lambda test, field, value: F.when(test, F.struct(F.lit(field).alias("field"), value.alias("value")))
    return F.array_compact(F.array(
        edit((last["title"] != now["title"]) & (F.trim(bare) != ""), "title", F.trim(bare)),
        edit(event & moved("start"), "start", moment("start")),
        edit(event & moved("end"), "end", moment("end")),
        edit(event & (last["all_day"] != now["all_day"]), "all_day", now["all_day"].cast("string")),
        edit(event & (where(last) != where(now)), "place", F.nullif(where(now), F.lit(""))),
        edit(~event & moved("due"), "due", moment("due")),
    ))


def sync_actions(items: DataFrame, links: DataFrame, stored: DataFrame, calendar: str | None, list_: str | None, now: int, most_age_days: int) -> DataFrame:
    """(item, action, reason): everything one sync does, from items, their links and what the calendar holds.

    links: (item, state, container, written, hash); stored: (item, container, completed, entry). ``written`` and
    ``entry`` are entries as ``rendered`` makes them.
    """
    each = rendered(items).join(links.select("item", F.col("state").alias("_state"), F.col("container").alias("_in"), "written", "hash"), "item", "left")
    each = each.join(stored.select("item", F.col("container").alias("_now_in"), "completed", F.col("entry").alias("_now"), F.lit(True).alias("_there")), "item", "left")
    event = F.col("family") == "event"
    wanted = F.when(event, F.lit(calendar).cast("string")).otherwise(F.lit(list_).cast("string"))
    none = F.when(event, "no-calendar").otherwise("no-list")
    active, state = F.col("status") == "active", F.col("_state")
    ready = active & ~F.col("needs_review")
    moment = F.when(event, F.col("start")).otherwise(F.coalesce("due", "start"))
    say = lambda action, reason: F.struct(F.lit(action).alias("action"), (F.lit(reason) if reason is None or isinstance(reason, str) else reason).cast("string").alias("reason"))
    create = (
        F.when(wanted.isNull(), say("skip", none)).when(event & F.col("start").isNull(), say("skip", "no-date"))
        .when(moment < now - most_age_days * DAY, say("skip", "too-old")).otherwise(say("create", None))
    )
    edits = outside_edits(F.col("written"), F.col("_now"), F.col("context"), F.col("zone"))
    same = (entry_hash(F.col("entry")) == F.col("hash")) & (state == "synced")
    decided = (
        F.when(state.isNull() & ready, create).when(state.isNull(), F.when(active, say("skip", "inbox")).otherwise(say("skip", "not-ready")))
        .when(state == "removed-by-user", F.when(ready, say("skip", "removed-by-user")))
        .when(state == "completed", say("skip", "completed"))
        .when(state == "removed", F.when(ready, create))
        .when(~active, say("remove", F.col("status"))).when(~ready, say("skip", "inbox"))
        .when(F.col("_there").isNull(), say("mark-removed", "deleted"))
        .when((F.col("_now_in") != F.col("_in")) & ~F.col("_now_in").eqNullSafe(wanted), say("mark-removed", "moved"))
        .when(~event & F.col("completed"), say("complete", None))
        .when(F.size(edits) > 0, say("adopt", F.array_join(F.transform(edits, lambda e: e["field"]), ",")))
        .when(wanted.isNull(), say("skip", none)).when(F.col("_in") != wanted, say("move", wanted))
        .when(same, say("skip", "unchanged")).otherwise(say("update", F.array_join(changed_fields(F.col("written"), F.col("entry")), ",")))
    )
    return each.select("item", decided.alias("x")).where("x is not null").select("item", "x.action", "x.reason")


def sync_sources(items: DataFrame, links: DataFrame, lines: DataFrame, most: int = 3) -> DataFrame:
    """(item, evidence): items that are linked, or active and reviewed, each with its newest lines of evidence."""
    linked = links.select("item", F.lit(True).alias("_l")).distinct()
    wanted = items.join(linked, "item", "left").where(F.col("_l") | ((F.col("status") == "active") & ~F.col("needs_review"))).select("item")
    from pyspark.sql import Window

    newest = lines.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy(F.col("at").desc(), "line"))).where(F.col("_n") <= most)
    shown = newest.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]).alias("evidence"))
    return wanted.join(shown, "item", "left").select("item", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
