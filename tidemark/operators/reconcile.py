"""Reconciliation: which item each finding belongs to, picture by picture.

Rules, in order, for a finding of a picture:

0. It equals (title and instant) a sighting that this picture had when it was read before: it stays with that item.
1. Items of its block are candidates if their times agree at all, unless they are to be kept apart from the item that this
   picture's earlier sighting of the same title belongs to. The best one to merge with takes it: 0.6 text + 0.4 time,
   then the one seen last, then the first name.
2. Uncertain ones: a window shows each event once, so candidates that its earlier findings took are no duplicates
   (``same-picture-different``). Another uncertain stored candidate makes a new item and a possible duplicate: there
   is no judge here, and undated findings are never judged (``undated-uncertain``, else ``judge-unavailable``).
3. Else a new item.

A decision depends on earlier ones of its block (library, context, family, and the day of events), never on another
block. Blocks stream sorted through the tasks, and only one block's items are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import Thresholds

FIELDS = "finding string, item string, rule string, candidate string, possible string, text double, time double, joined boolean"
SECOND, DAY = 1_000_000, 86_400_000_000
#: A span of more slots than these is met by every finding instead.
MOST_SLOTS = 200


def similarity(a: str, b: str) -> float:
    """As ``functions.text.title_similarity`` has it."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 8 and long.startswith(short):
        return 0.95
    x, y = set(a.split(" ")), set(b.split(" "))
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (p != q))
    return max(1 - row[-1] / len(long), 2 * len(x & y) / (len(x) + len(y)))


@dataclass(frozen=True)
class Span:
    start: int | None
    end: int | None
    all_day: bool
    day: str | None


def agreement(a: Span, b: Span, event: bool) -> float:
    """As ``functions.times`` has it."""
    if a.start is None or b.start is None:
        return float(a.start is None and b.start is None)
    gap, same = abs(a.start - b.start), a.day == b.day
    if not event:
        return 0.0 if gap > DAY else 1.0 if gap < SECOND else 0.8 if same else 0.6
    if not same:
        return 0.0
    if a.all_day or b.all_day:
        return 1.0 if a.all_day and b.all_day else 0.5
    if gap < SECOND:
        return 1.0
    if a.start < max(b.end or b.start, b.start) and b.start < max(a.end or a.start, a.start):
        return 0.8
    return 0.6 if gap <= 900 * SECOND else 0.0


def decided(text: float, time: float, undated: bool, t: Thresholds) -> str:
    """As ``linkage.decide`` has it, without a cosine."""
    if undated:
        return "merge:undated-text" if text >= t.undated else "new:undated-low-text" if text < t.undated_low else "uncertain:"
    if text >= t.text and time >= t.time:
        return "merge:text-time"
    return "uncertain:" if time >= t.time_alone or text >= t.text_low else "new:different"


@dataclass
class Item:
    name: str
    titles: set = field(default_factory=set)
    seen: int = 0
    sightings: dict = field(default_factory=dict)  # (image, n) -> (title, span, at, read, turn)
    best: list = field(default_factory=list)  # heap of (rank, turn, key), the removed ones too until they come up

    def add(self, key: tuple, title: str, span: Span, at: int, read: bool, turn: int) -> None:
        self.sightings[key] = (title, span, at, read, turn)
        heappush(self.best, ((not read, span.all_day, -at), turn, key))

    def span(self) -> Span:
        """Of what was read before what was inferred, timed before all-day, then the newest."""
        while True:
            _, turn, key = self.best[0]
            found = self.sightings.get(key)
            if found and found[4] == turn:
                return found[1]
            heappop(self.best)


class Block:
    """The items of one block.

    Items are found by when they are, so that a finding is compared with those whose times can agree only: a span is in
    slots of a quarter of an hour, or a day for to-dos, and the next ones. All-day items and long spans are in no
    slot and met by every dated finding. Sightings are found by their picture.
    """

    def __init__(self, event: bool, t: Thresholds):
        self.event, self.t = event, t
        self.items: dict[str, Item] = {}
        self.apart: set[tuple[str, str]] = set()
        self.known: dict[tuple[str, str], float] = {}
        self.pictures: dict[str, list[tuple[tuple, str]]] = {}  # image -> (key of a sighting, item)
        self.slots: dict[int | str, set[str]] = {}
        self.places: dict[str, tuple[Span, list]] = {}  # item -> its span in the slots, and those slots
        self.turn = 0

    def like(self, a: str, b: str) -> float:
        key = (a, b) if a < b else (b, a)
        if key not in self.known:
            self.known[key] = similarity(*key)
        return self.known[key]

    def _slots(self, span: Span, beyond: int) -> list:
        """Those of a span and so many to either side; ``long`` if there are too many to list."""
        if span.start is None:
            return ["undated"]
        width = 900 * SECOND if self.event else DAY
        last = max(span.end or span.start, span.start) if self.event else span.start
        first, last = span.start // width - beyond, last // width + beyond
        return ["long"] if self.event and span.all_day or last - first >= MOST_SLOTS else list(range(first, last + 1))

    def _place(self, item: Item | None, name: str) -> None:
        """Puts an item where its span is now; without sightings it is nowhere."""
        span = item.span() if item and item.sightings else None
        old, slots = self.places.pop(name, (None, []))
        if span is None or span != old:
            for s in slots:
                self.slots[s].discard(name)
            slots = self._slots(span, 1) if span else []
            for s in slots:
                self.slots.setdefault(s, set()).add(name)
        if span:
            self.places[name] = (span, slots)

    def _near(self, span: Span, extra: dict) -> set[str]:
        """Names of the items whose times may agree with a span, this picture's own among them."""
        slots = self._slots(span, 0)
        if slots == ["long"]:
            return set(self.items)
        return set(extra).union(*(self.slots.get(s, ()) for s in (slots if slots == ["undated"] else [*slots, "long"])))

    def picture(self, rows: list) -> Iterator[tuple]:
        """Takes one picture's findings, in order; earlier sightings of the same picture are replaced."""
        image = rows[0].image
        was = self.pictures.get(image, [])
        earlier = sorted((key, name, *self._said(name, key)) for key, name in was)
        used, claimed, extra, fresh = set(), {}, {}, set()
        placed: list[tuple[str, tuple]] = []
        for n, row in enumerate(rows):
            span = Span(None if pd.isna(row.start) else int(row.start), None if pd.isna(row.end) else int(row.end), bool(row.all_day), row.day)
            same = next((e for e in earlier if e[0] not in used and e[2] == row.title and _instant(e[3], span.start)), None)
            took = claimed.setdefault(row.window or "", set())
            if same:
                used.add(same[0])
                name, told = same[1], (row.finding, same[1], "same-picture", same[1], None, None, None, True)
            else:
                name, told = self._matched(row, span, earlier, took, extra, fresh)
            if name not in self.items:
                self.items[name] = Item(name)
                fresh.add(name)
            took.add(name)
            extra.setdefault(name, []).append((row.title, span))
            placed.append((name, ((image, n), row.title, span, row.at, not bool(row.inferred))))
            yield told
        for key, name in was:
            del self.items[name].sightings[key]
        for name, sighting in placed:
            item = self.items[name]
            self.turn += 1
            item.add(*sighting, self.turn)
            item.titles.add(sighting[1])
            item.seen = max(item.seen, sighting[3])
        self.pictures[image] = [(sighting[0], name) for name, sighting in placed]
        for name in {e[1] for e in earlier}:
            if not self.items[name].sightings:
                del self.items[name]  # nothing is left of it
        for name in {*extra, *(e[1] for e in earlier)}:
            self._place(self.items.get(name), name)

    def _said(self, name: str, key: tuple) -> tuple[str, int | None]:
        title, span = self.items[name].sightings[key][:2]
        return title, span.start

    def _matched(self, row, span: Span, earlier: list, took: set, extra: dict, fresh: set) -> tuple[str, tuple]:
        blocked = next((e[1] for e in earlier if e[2] == row.title), None)
        scored = []
        for item in map(self.items.get, self._near(span, extra)):
            if blocked and tuple(sorted((item.name, blocked))) in self.apart:
                continue
            more = extra.get(item.name, [])
            spans = ([item.span()] if item.sightings else []) + [s for _, s in more]
            time = max((agreement(span, s, self.event) for s in spans), default=0.0)
            if time == 0:
                continue
            text = max(self.like(row.title, title) for title in item.titles | {x for x, _ in more})
            seen = float("inf") if item.name in fresh else item.seen
            scored.append((-(0.6 * text + 0.4 * time), -seen, item.name, text, time, decided(text, time, span.start is None, self.t)))
        scored.sort()
        for _, _, name, text, time, decision in scored:
            if decision.startswith("merge:"):
                return name, (row.finding, name, decision[6:], name, None, text, time, True)
        uncertain = [s for s in scored if s[5] == "uncertain:"]
        open_ = [s for s in uncertain if s[2] not in took]
        if uncertain:
            _, _, name, text, time, _ = (open_ or uncertain)[0]
            rule = "undated-uncertain" if span.start is None else "judge-unavailable" if open_ else "same-picture-different"
            stored = bool(open_) and name not in fresh
            return row.finding, (row.finding, row.finding, rule, name if name not in fresh else None, name if stored else None, text, time, False)
        rule, text, time = (scored[0][5][4:], scored[0][3], scored[0][4]) if scored else ("no-candidate", None, None)
        return row.finding, (row.finding, row.finding, rule, None, None, text, time, False)


def _instant(a: int | None, b: int | None) -> bool:
    return a is None and b is None or a is not None and b is not None and abs(a - b) < SECOND


def reconciled(findings: DataFrame, apart: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each finding: its item (named after the item's first finding), the rule, scores, and a possible duplicate.

    findings: library, context, family (event or todo), day (local, null if undated), image, at, n, window, finding,
    title (normalised), start, end (microseconds), all_day, inferred; at and n give the order of pictures and of their
    findings. ``apart``: library, context, family, item_a, item_b that are never to be joined again.
    """
    said = findings.select(
        "library", "context", "family", "day", "image", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "window", F.col("finding").cast("string").alias("finding"), "title",
        F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("all_day"), F.col("inferred"), F.lit(None).cast("string").alias("other"),
    )
    key = F.when(F.col("family") == "event", F.coalesce("day", F.lit(""))).otherwise(F.when(F.col("day").isNull(), "").otherwise("dated"))
    rows = said.withColumn("block", key)
    if apart is not None:
        days = rows.select("library", "context", "family", "block").distinct()
        pairs = days.join(apart, ["library", "context", "family"])  # a pair is known in each of its context's blocks
        blank = {c: F.lit(None).cast(k) for c, k in rows.dtypes}
        blank |= {c: F.col(c) for c in ("library", "context", "family", "block")} | {"finding": F.col("item_a"), "other": F.col("item_b"), "at": F.lit(-(1 << 62)), "n": F.lit(0)}
        rows = rows.unionByName(pairs.select(*[blank[c].cast(k).alias(c) for c, k in rows.dtypes]))
    keys = ["library", "context", "family", "block"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "at", "image", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block, held = None, None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                here = tuple(getattr(row, k) for k in keys)
                if held and (here != at or (row.at, row.image) != (held[0].at, held[0].image)):
                    out += block.picture(held)
                    held = []
                if here != at:
                    at, block = here, Block(row.family == "event", t)
                if row.other is not None:
                    block.apart.add(tuple(sorted((row.finding, row.other))))
                else:
                    held.append(row)
            if out:
                yield _framed(out)
        if held:
            yield _framed(list(block.picture(held)))

    return ordered.mapInPandas(run, FIELDS)


def _framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in FIELDS.split(", ")])


def observations(findings: DataFrame) -> DataFrame:
    """(finding, field, value, source, confidence) of findings: title and all-day always, the others where they say something.

    findings: finding, title, all_day, start, end, due, remind, people, place, notes, inferred (names), confidence.
    """
    inferred = lambda f: F.when(F.array_contains("inferred", f), "inferred").otherwise("read")
    some = lambda f, value, source: F.when(value.isNotNull() & (value != ""), F.struct(F.lit(f).alias("field"), value.alias("value"), source.alias("source")))
    read = F.lit("read")
    rows = [F.struct(F.lit("title").alias("field"), F.coalesce("title", F.lit("")).alias("value"), read.alias("source")), F.struct(F.lit("all_day").alias("field"), F.coalesce("all_day", F.lit(False)).cast("string").alias("value"), read.alias("source"))]
    rows += [some(f, F.col(f).cast("string"), inferred(f)) for f in ("start", "end", "due", "remind")]
    rows += [some("people", F.when(F.size("people") > 0, F.to_json("people")), read), some("place", F.col("place"), read), some("notes", F.col("notes"), read)]
    told = findings.select("finding", F.explode(F.array_compact(F.array(*rows))).alias("o"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))).alias("confidence"))
    return told.select("finding", "o.field", "o.value", "o.source", "confidence")
