"""The trie against one built by hand: odd rows, long conversations that need several rounds of names, copies."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie
from tidemark.llm import queries as Q

COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    out = Counter()
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if made[c] == k)))
        out[(min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def got(spark, folder):
    return Counter(tuple(r[c] for c in COLS) for r in Q.op13_prefix_trie(spark, folder).collect())


def test_odd_conversations(spark, stored, monkeypatch):
    monkeypatch.setattr(prefix_trie, "WIDTH", 4)
    monkeypatch.setattr(prefix_trie, "BUCKET", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    rnd, rows = random.Random(8), []
    for c in [*range(-12, 60)]:
        for turn in range(rnd.choice([1, 1, 2, 5, 12, 40])):
            rows.append((c, turn, "user" if turn % 2 == 0 else rnd.choice(["assistant", None]), rnd.choice(["a", "b", "é😀", "", None])))
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(9)] + [(300, None, None, None), (300, None, "x", "y"), (300, 1, "x", "y"), (300, 1, "x", "y"), (None, 0, "user", "lost")]
    rows += [(401, t, "user", str(t % 3)) for t in range(150)] + [(402, t, "user", str(t % 3) if t < 149 else "z") for t in range(150)] + [(403, t, "user", str(t % 3)) for t in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("node", "d", "pos", "at", "n", "size", "key", "lo", "part"):
        df = df.withColumn(name, F.lit("c"))
    assert got(spark, stored(conversations=df.repartition(3))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(3, 0, "user", "x")], [(None, 0, "user", "x")]])
def test_few_rows(spark, stored, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(spark, stored(conversations=df)) == plain(rows)
