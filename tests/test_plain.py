"""Queries that have no SQL counterpart, against plain walks over the same rows."""

import re
from collections import defaultdict

from tidemark.plans import catalogue, geometry
from tidemark.sources.tables import table

SF = "/root/testdata/sf0.001"


def pictures(spark):
    found = defaultdict(list)
    for r in geometry.boxes(spark, SF).collect():
        found[r.image].append((r.id, r.confidence, tuple(r.box)))
    return found


def shared(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def test_box_suppression(spark):
    want = set()
    for image, boxes in pictures(spark).items():
        kept = []
        for i, _, box in sorted(boxes, key=lambda b: (-b[2][2], -b[1], b[0])):
            if all(2 * shared(box, k) < min(box[2] * box[3], k[2] * k[3]) for k in kept):
                kept.append(box)
                want.add((image, i))
    assert {tuple(r) for r in catalogue.QUERIES["box_suppression"](spark, SF).collect()} == want


def test_occlusion_shares(spark):
    few = {image: boxes for image, boxes in pictures(spark).items() if image % 10 == 0}
    got = {(r.image, r.window): r.share for r in catalogue.QUERIES["occlusion_shares"](spark, SF).collect()}
    for image, boxes in few.items():
        front = set()
        if len({b[0] for b in boxes}) < len(boxes):
            continue  # two windows of one name
        for i, _, (x, y, w, h) in sorted(boxes):
            mine = {(p, q) for p in range(x, x + w) for q in range(y, y + h)}
            assert abs(got[image, i] - len(mine - front) / (w * h)) < 1e-9
            front |= mine


def test_session_notice_ceiling(spark):
    hour, times = 3_600_000_000, defaultdict(list)
    rows = catalogue.QUERIES["session_notice_ceiling"](spark, SF)
    for r in table(spark, SF, "events").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) AS t").collect():
        times[r.user_id].append(r.t)
    want = set()
    for user, at in times.items():
        open_ = None
        for t in sorted(at):
            if open_ and t <= open_[1]:
                open_ = (open_[0], min(t + 6 * hour, open_[0] + 24 * hour), open_[2] + 1)
            else:
                if open_:
                    want.add((user, *open_))
                open_ = (t, t + 6 * hour, 1)
        want.add((user, *open_))
    assert {tuple(r) for r in rows.collect()} == want


def similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, q in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (p != q))
    edit = 1 - row[-1] / max(len(a), len(b))
    short, long = sorted((a, b), key=len)
    return max(edit, 0.8 + 0.2 * len(short) / len(long) * 0.99) if len(short) >= 3 and short in long else edit


def test_greedy_matches(spark):
    cases = defaultdict(list)
    for r in table(spark, SF, "conversations").collect():
        cases[r.conv_id].append((r.turn, re.sub(r"[\W_]", "", (r.text or "").lower())))
    want = set()
    for case, turns in cases.items():
        pairs = [(-similarity(x, y), abs(a - b), a, b) for a, x in turns if a % 2 == 0 for b, y in turns if b % 2 == 1 and abs(a - b) <= 5]
        left, right = set(), set()
        for s, _, a, b in sorted(p for p in pairs if -p[0] >= 0.2):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((case, a, b, round(-s, 6)))
    assert {tuple(r) for r in catalogue.QUERIES["greedy_matches"](spark, SF).select("case", "want", "got", "score").collect()} == want
