import math
import random

import numpy as np

from tidemark.llm import queries as Q
from tidemark.llm import topk_search as S


def plain(rows, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = set(), sorted((i, v, n) for n, (i, v) in enumerate(good) if i % 100 == 0)
    for place, (q, a, own) in enumerate(asked):
        number = place - min(p for p, x in enumerate(asked) if x[0] == q)
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(good) if n != own)
        out |= {(q, number, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = S.integer_vectors(df, "vec_id", "embedding")
    return {tuple(r) for r in S.top_k(vectors, vectors.where(S.divisible(vectors["id"])), k, **kw).collect()}


def test_like_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(k, [rnd.gauss(0, 1) + (k % 5 == d) for d in range(8)]) for k in range(700)]
    rows += [(800 + k, rows[0][1]) for k in range(30)] + [(900, None), (901, [float("nan")] * 8), (902, [float("inf")] * 8), (903, [None, 1.0]), (904, []), (905, [1.0]), (None, [1.0] * 8), (1000, [0.0] * 8)]
    want = plain(rows, 10)
    assert run(spark, rows) == want
    assert run(spark, rows, batch_values=16) == want


def test_few_rows(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 0, 1, 1, 2048 * 1024)}
    assert run(spark, [(0, [1.0])]) == set() and run(spark, []) == set()


def test_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [-1.0, 0.5]), (100, [3.0, 0.0]), (7, [1.0, 1.0]), (200, [1.0, 2.0])] + [(k, [0.5, 0.25]) for k in (1, 1, 2)]
    assert run(spark, rows, k=4) == plain(rows, 4)
    assert run(spark, rows, k=4, batch_values=1) == plain(rows, 4)


def test_large_components(spark):
    rows = [(0, [2.9e6, 1.0]), (1, [2e6, -5.0]), (2, [-1e6, 4e6])]
    assert run(spark, rows) == plain(rows, 10)


def test_registered_query(spark, stored):
    rows = [(k, [float(k % 7), -1.0, k / 3]) for k in range(230)] + [(300, None), (5, [1.0, None, 2.0])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, score string")
    got = {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in Q.op2_topk_search(spark, stored(embeddings=df)).collect()}
    assert got == {(q, r, i, s) for q, _, r, i, s in plain(rows, 10)}


def test_blocks_are_pruned():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-900, 900, (20, 16))
    matrix = (centres[np.arange(6000) % 20] + rnd.integers(-20, 20, (6000, 16))).astype(np.int64)
    best = [S.Best(10) for _ in range(5)]
    scored = S.scan_rows(np.arange(6000), matrix, matrix[:5], best)
    assert scored < 0.5 * 5 * (6000 // S.BLOCK)
    for q in range(5):
        scores = matrix @ matrix[q]
        order = [i for i in np.lexsort((np.arange(6000), -scores)) ][:10]
        assert best[q].ids.tolist() == order
