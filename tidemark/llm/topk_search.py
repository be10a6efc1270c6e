"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers; each dimension is a term. A task holds its rows in document-range blocks (rows near each
other in a coarse clustering side by side), each block with a forward index (the integer matrix) and every term's
largest and smallest value. A query's bound for a block is the sum over terms of the larger of its products with
these two; blocks are scored from the highest bound down, until the bound falls below the k-th score so far. What a
task keeps for a query is merged with the other tasks' by rank, so results are exact.

Queries come in batches of bounded size, each broadcast; all rows are scanned for each batch, and nothing but the
k + 1 best of each task is shuffled. A query's own row is among them and is taken out last.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no part;
shorter vectors count as zero in the missing dimensions; rows of one id are rows of their own, as queries (numbered by
``query``) and as candidates, and of a repeated row only one is the query's own; ties go to the smaller id; scores have
to fit a long (else OverflowError), a query's with itself too. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Query components that one broadcast holds at most (8 bytes each).
BATCH_VALUES = 2_000_000
#: Rows of a block, and rows that a task holds at a time.
BLOCK, HELD = 64, 32_768
#: Blocks scored between two looks at the bound.
STEP = 8


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): the rows that take part, their components as floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    usable = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def query_batches(queries: DataFrame, batch_values: int = BATCH_VALUES) -> list[DataFrame]:
    """Different (id, v) queries dealt by hash into batches of about ``batch_values`` components, by half more at most.

    Ends, as different rows get apart by and by and a single row is never too much.
    """
    total = queries.agg(F.sum(F.size("v")), F.max(F.size("v"))).first()
    n = max(1, math.ceil((total[0] or 0) / batch_values))
    while n > 1:
        place = F.pmod(F.xxhash64("id", "v"), F.lit(n))
        largest = queries.groupBy(place.alias("p")).agg(F.sum(F.size("v")).alias("s")).agg(F.max("s")).first()[0]
        if largest <= 1.5 * max(batch_values, total[1]):
            return [queries.where(place == k) for k in range(n)]
        n *= 2
    return [queries]


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _clustered(matrix: np.ndarray, pivots: int = 64) -> np.ndarray:
    """An order that puts rows with the same nearest pivot side by side; pivots are rows at even distances."""
    chosen = matrix[:: max(1, len(matrix) // pivots)][:pivots].astype(np.float64)
    near = matrix.astype(np.float64) @ chosen.T - 0.5 * (chosen**2).sum(1)
    return np.argsort(near.argmax(1), kind="stable")


class Best:
    """The k best (score, id) of one query, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            good = scores >= self.scores[-1]
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]


def scan_rows(ids: np.ndarray, matrix: np.ndarray, queries: np.ndarray, best: list[Best]) -> int:
    """Takes the rows into the queries' best, block by block; returns the number of blocks scored."""
    order = _clustered(matrix)
    ids, matrix = ids[order], matrix[order]
    spare = -len(ids) % BLOCK
    starts = np.arange(0, len(ids), BLOCK)
    tops, lows = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
    reach = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, matrix.shape[1])
    kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**63 else object  # sums of any kind stay whole numbers
    held = np.concatenate([matrix, np.zeros((spare, matrix.shape[1]), np.int64)]).astype(kind).reshape(len(starts), BLOCK, -1)
    all_ids, real = np.concatenate([ids, np.zeros(spare, np.int64)]).reshape(-1, BLOCK), (np.arange(len(ids) + spare) < len(ids)).reshape(-1, BLOCK)
    positive, negative = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    scored = 0
    for at in range(0, len(queries), 256):
        bounds = positive[at : at + 256] @ tops.astype(kind).T + negative[at : at + 256] @ lows.astype(kind).T
        ranked = np.argsort(-bounds, axis=1, kind="stable")
        for k, (bound, blocks) in enumerate(zip(bounds, ranked, strict=True)):
            q, mine = queries[at + k].astype(kind), best[at + k]
            for s in range(0, len(blocks), STEP):
                some = blocks[s : s + STEP]
                some = some[bound[some] >= mine.floor()]
                if not len(some):
                    break
                scored += len(some)
                scores, names, take = held[some] @ q, all_ids[some], real[some]
                mine.add(_longs(scores[take]), names[take])
    return scored


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores.tolist()):
        raise OverflowError("a score does not fit a long")
    return scores.astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, batch_values: int = BATCH_VALUES) -> DataFrame:
    """(query_id, query, rank, vec_id, score) of each query's k best among (id, v) rows other than its own.

    ``query`` numbers the queries of one id, from 0; of them those with equal vectors are asked once.
    """
    spark, parts = vectors.sparkSession, []
    numbered = queries.groupBy("id", "v").agg(F.count("*").alias("times"))
    numbered = settled(numbered.withColumn("first", F.sum("times").over(Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")))
    vectors = settled(vectors) if (numbered.agg(F.sum(F.size("v"))).first()[0] or 0) > batch_values else vectors
    for batch in query_batches(numbered, batch_values):
        asked = batch.toPandas()  # bounded by batch_values
        dims = max(map(len, asked["v"]), default=0)
        sent = spark.sparkContext.broadcast((asked["id"].to_numpy(np.int64), asked["first"].to_numpy(np.int64), _matrix(list(asked["v"]), dims)))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            query_ids, first, matrix = sent.value
            best = [Best(k + 1) for _ in query_ids]

            def take(held: list[pd.DataFrame]) -> None:
                rows = pd.concat(held)
                wide = max(matrix.shape[1], max(map(len, rows["v"]), default=0))
                padded = np.pad(matrix, ((0, 0), (0, wide - matrix.shape[1])))
                scan_rows(rows["id"].to_numpy(np.int64), _matrix(list(rows["v"]), wide), padded, best)

            held, n = [], 0
            for rows in batches:
                held.append(rows)
                n += len(rows)
                if n >= HELD:
                    take(held)
                    held, n = [], 0
            if n:
                take(held)
            for q in range(0, len(query_ids), 1000):
                some = best[q : q + 1000]
                sizes = [len(b.ids) for b in some]
                yield pd.DataFrame({
                    "query_id": np.repeat(query_ids[q : q + 1000], sizes),
                    "first": np.repeat(first[q : q + 1000], sizes),
                    "vec_id": np.concatenate([b.ids for b in some]),
                    "score": np.concatenate([b.scores for b in some]),
                })

        parts.append(vectors.mapInPandas(search, "query_id long, first long, vec_id long, score long"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    times = numbered.select(F.col("id").alias("query_id"), "first", "times", _square(F.col("v")).alias("own"))
    best = Window.partitionBy("query_id", "first").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).join(times, ["query_id", "first"])
    # the query's own row has its id and the score of its vector with itself: one such row goes, if it is among the best
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    at = F.min(F.when(own, F.col("rank"))).over(Window.partitionBy("query_id", "first"))
    ranked = ranked.withColumn("at", at).where(~F.col("rank").eqNullSafe(F.col("at")))
    ranked = ranked.withColumn("rank", F.col("rank") - F.coalesce((F.col("at") < F.col("rank")).cast("int"), F.lit(0))).where(F.col("rank") <= k)
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1))
    return ranked.select("query_id", each.alias("query"), "rank", "vec_id", "score")


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x * x)


def divisible(id_col: Column, by: int = 100) -> Column:
    return id_col % by == 0
