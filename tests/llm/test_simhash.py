import random

import numpy as np
import xxhash

from tidemark.llm import simhash as S
from tidemark.llm.components import components


def plain_fingerprint(text, shingle):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, most):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(fps))]


def same(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_fingerprints_and_groups(spark, docs):
    rnd = random.Random(5)
    vocabulary = [f"Wort{k}" for k in range(300)]
    rows = []
    for k in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 4, 40, 300]))]
        rows.append((k, " ".join(words)))
        for c in range(k % 4):
            at = rnd.randrange(len(words) + 1)
            rows.append((1000 + 10 * k + c, "\n\t ".join(words[:at] + ["x"] * (c % 2) + words[at:])))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (None, "Wort1"), (7, "Wort1")]
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    for most in (4, 12):
        got = {(r.doc_id, r.f[0] & (2**64 - 1)): r.component_id for r in S.near_duplicates(docs(rows), 4, most).collect()}
        groups = plain_groups(fps, most)
        least = [min((i for (i, _), g in zip(rows, groups, strict=True) if g == group and i is not None), default=None) for group in groups]
        assert [got[i, f] for (i, _), f in zip(rows, fps, strict=True)] == least
    assert S.near_duplicates(docs([]), 4, 4).count() == 0


def test_crowded_keys(spark):
    rnd = np.random.default_rng(2)
    fps = [int(x) for x in rnd.integers(0, 1 << 63, 150, dtype=np.uint64)]
    fps += [(fps[0] ^ (1 << int(a))) ^ (1 << int(b)) for a, b in rnd.integers(0, 64, (250, 2))]
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f, [f]) for f in signed], "name long, f array<long>")
    for rows in (40_000, 20):
        root = {r.v: r.root for r in components(S.links(df, 4, key_rows=rows)).collect()}
        assert same([root.get(f, f) for f in signed], plain_groups(fps, 4))


def test_plans_cover_the_threshold():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (10, 10**5, 10**9):
        for most in (0, 3, 4, 12):
            parts = S.plan(sample, n, most)
            bits = [b for p in parts for b in p.bits]
            assert len(bits) == len(set(bits))
            assert sum(p.threshold + 1 for p in parts) == most + 1  # unprobed partitions count -1 + 1 = 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.v, r.root) for r in components(links).collect()} == {(k, 0) for k in range(1, 51)} | {(101, 100)}
    assert components(links.limit(0)).count() == 0
