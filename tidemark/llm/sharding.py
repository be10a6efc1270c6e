"""Sharding by sampled splitters.

Keys are a hash of the text, then one of the id, so equal texts are neighbours. Rows are drawn into a sample with
probability in proportion to their size (by a hash, so reruns agree); quantiles of the sample become splitters, and
records are range-partitioned between them into many more ranges than shards. Ranges that turn out overfull are
subdivided by splitters drawn inside them. Exact sums of the ranges, then running sums inside each range, give every
record its place in the order of all bytes; the place decides the shard, and the count before it the slot.

Equal texts share a shard. Groups of over ``BIG`` of a range (there are few, by their sizes) get ranges of their own and
are dealt to shards first, the largest to the emptiest; all other records fill the shards up to a common level in the
order of their keys, a group with its middle. Only a group of more bytes than a shard's share is dealt row by row.

Defined results: a null text has no bytes; each row adds 8 bytes, so empty ones spread too; repeated rows, null ids
and ties each get a slot of their own; with fewer bytes than shards some shards are empty; an empty table gives no
rows. Other columns are carried; ones named like the operator's own are replaced.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled

#: Ranges: at least so many for each shard, and at least one for so many rows; no more than so many in all.
RANGES_PER_SHARD, ROWS_PER_RANGE, MOST_RANGES = 64, 50_000, 65_536
#: Sampled keys for each range, and rounds of subdividing overfull ranges (over so many times the mean).
SAMPLED, ROUNDS, OVERFULL = 8, 4, 3.0
#: Groups over this part of a range's mean bytes are dealt one by one: at most 1 / BIG for each range.
BIG = 0.25


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _unit(*cols: Column) -> Column:
    """A hash of the columns as a number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("draw"), *cols), 11).cast("double") / float(1 << 53)


def _range_of(key: Column, tie: Column, splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below (key, tie)."""
    keys, ties = (np.array([s[k] for s in splitters], dtype=np.int64) for k in (0, 1))

    @F.pandas_udf(T.IntegerType())
    def ranged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, t in batches:
            k, t = k.to_numpy(np.int64), t.to_numpy(np.int64)
            low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            tied = np.nonzero(high > low)[0]
            out = low.copy()
            for at in np.unique(low[tied]):
                rows = tied[low[tied] == at]
                out[rows] += np.searchsorted(ties[at : high[rows[0]]], t[rows], "right")
            yield pd.Series(out.astype(np.int32))

    return ranged(key, tie)


def _quantiles(sample: list, pieces: int, cut: set[int]) -> list[tuple[int, int]]:
    """Up to pieces - 1 splitters from (key, tie, weight) rows; only keys in ``cut`` are cut inside."""
    sample = sorted(sample, key=lambda r: (r[0], r[1]))
    total, run, out = sum(r[2] for r in sample), 0.0, []
    for key, tie, weight in sample:
        before, run = run, run + weight
        if int(run * pieces / total) > int(before * pieces / total) and int(run * pieces / total) < pieces:
            out.append((key, tie if key in cut else -(1 << 63)))
    return sorted(set(out))


def _draw(rows: DataFrame, per: Column, salt: int) -> list:
    """(key, tie, weight) of rows drawn with probability ``size / per``, 1 at most; ``per`` is the mean weight of a draw."""
    chance = F.least(F.lit(1.0), F.col("_sh_size") / per)
    drawn = rows.where(_unit(F.col("_sh_key"), F.col("_sh_tie"), F.lit(salt)) < chance)
    return [tuple(r) for r in drawn.select("_sh_key", "_sh_tie", F.greatest(per.cast("double"), F.col("_sh_size").cast("double"))).collect()]


def splitters(rows: DataFrame, ranges: int, cut: set[int]) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Splitters of about ``ranges`` ranges over (_sh_key, _sh_tie, _sh_size), and each range's bytes and rows.

    Keys in ``cut`` have ranges of their own, several if they are large; no other key is in two ranges. The driver sees
    samples of about ``SAMPLED * ranges`` keys and one row for each range.
    """
    total = rows.agg(F.sum("_sh_size")).first()[0]
    if not total:
        return [], {}
    edges = {(k + d, -(1 << 63)) for k in cut for d in (0, 1) if k + d < 1 << 63}
    found = sorted(edges.union(_quantiles(_draw(rows, F.lit(total / (ranges * SAMPLED)), 0), ranges, cut)))
    for k in range(ROUNDS + 1):
        counted = rows.groupBy(_range_of(F.col("_sh_key"), F.col("_sh_tie"), found).alias("r")).agg(
            F.sum("_sh_size").alias("b"), F.count("*").alias("n"), F.max("_sh_size").alias("m")
        )
        sums = {r["r"]: (r["b"], r["n"], r["m"]) for r in counted.collect()}
        wide = {r: b for r, (b, n, m) in sums.items() if n > 1 and b > OVERFULL * total / ranges and b - m > total / ranges}
        if not wide or k == ROUNDS:
            return found, {r: (b, n) for r, (b, n, _) in sums.items()}
        inside = rows.withColumn("_sh_r", _range_of(F.col("_sh_key"), F.col("_sh_tie"), found)).where(F.col("_sh_r").isin(list(wide)))
        more = _draw(inside, F.lit(total / (ranges * SAMPLED)), k + 1)
        edges, by_range = sorted(found), {}
        for row in more:
            by_range.setdefault(bisect_right(edges, (row[0], row[1])), []).append(row)
        new = set(found)
        for r, sample in by_range.items():
            new |= set(_quantiles(sample, max(2, round(wide.get(r, 0) * ranges / total)), cut))
        if new == set(found):
            return found, {r: (b, n) for r, (b, n, _) in sums.items()}
        found = sorted(new)
    return found, {}


def assign_shards(rows: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", size: str | None = None, text_hash: str | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot`` to every row.

    ``size`` and ``text_hash`` name columns that stand for the text's where rows come without it.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    key = F.xxhash64(text) if text_hash is None else F.col(text_hash)
    keyed = rows.select(
        F.struct(*kept).alias("_sh_row"), F.col(doc_id).alias("_sh_id"), key.alias("_sh_key"), F.xxhash64(F.lit("tie"), F.col(doc_id)).alias("_sh_tie"),
        (record_size(F.col(text)) if size is None else F.col(size)).alias("_sh_size"),
    )
    narrow = settled(keyed.select("_sh_key", "_sh_tie", "_sh_size"))
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum("_sh_size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(RANGES_PER_SHARD * shards, n // ROWS_PER_RANGE))
    groups = narrow.groupBy("_sh_key").agg(F.sum("_sh_size").alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") > BIG * total / ranges))
    big = {r["_sh_key"]: r["b"] for r in groups.collect()}  # at most ranges / BIG
    over = {k for k, b in big.items() if b * shards > total}
    home, ends = dealt({k: b for k, b in big.items() if k not in over}, total, shards)
    found, sums = splitters(narrow, ranges, set(big))
    offsets, free, count, own = [], 0, 0, [0] * shards
    for r in range(len(found) + 1):
        bytes_in, rows_in = sums.get(r, (0, 0))
        shard = home.get(found[r - 1][0]) if r else None
        if shard is None:
            offsets.append((r, free, count, None))
            free, count = free + bytes_in, count + rows_in
        else:
            offsets.append((r, 0, own[shard], shard))
            own[shard] += rows_in
    ranged = keyed.withColumn("_sh_r", _range_of(F.col("_sh_key"), F.col("_sh_tie"), found))
    places = rows.sparkSession.createDataFrame(offsets, "_sh_r2 int, _sh_b long, _sh_n long, _sh_home int")
    order = Window.partitionBy("_sh_r").orderBy("_sh_key", "_sh_tie", "_sh_id")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_sh_r", "_sh_key")
    laid = ranged.join(F.broadcast(places), F.col("_sh_r") == F.col("_sh_r2"))
    laid = laid.withColumn("_sh_start", F.col("_sh_b") + F.sum("_sh_size").over(upto) - F.col("_sh_size")).withColumn("_sh_at", F.col("_sh_n") + F.row_number().over(order) - 1)
    middle = lambda start, size: start + size / 2  # noqa: E731  of a row's or a whole group's bytes
    alone = F.col("_sh_key").isin(list(over)) if over else F.lit(False)
    spot = F.when(alone, middle(F.col("_sh_start"), F.col("_sh_size"))).otherwise(middle(F.min("_sh_start").over(whole), F.sum("_sh_size").over(whole)))
    passed = F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= F.col("_sh_spot"))
    laid = laid.withColumn("_sh_spot", spot).withColumn("shard", F.coalesce("_sh_home", F.least(F.size(passed), F.lit(shards - 1))).cast("int"))
    seen = laid.groupBy("shard").agg(F.min(F.when(F.col("_sh_home").isNull(), F.col("_sh_at"))).alias("f"), F.count(F.when(F.col("_sh_home").isNull(), 1)).alias("c")).collect()
    lookup = lambda c: F.create_map(*[F.lit(x) for r in seen for x in (r["shard"], r[c] or 0)]).cast("map<int,bigint>")[F.col("shard")] if seen else F.lit(0)
    slot = F.when(F.col("_sh_home").isNull(), F.col("_sh_at") - lookup("f")).otherwise(F.col("_sh_at") + lookup("c"))
    return laid.withColumn("slot", slot.cast("long")).select("_sh_row.*", "shard", "slot")


def dealt(groups: dict[int, int], total: int, shards: int) -> tuple[dict[int, int], list[float]]:
    """Each group's shard, the largest groups first, and where in the other records' bytes each shard ends."""
    room, home = [(0, k) for k in range(shards)], {}
    for key, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        filled, shard = heapq.heappop(room)
        home[key] = shard
        heapq.heappush(room, (filled + size, shard))
    by_shard = dict((k, b) for b, k in room)
    rest, level = total - sum(groups.values()), 0.0
    for n, (filled, _) in enumerate(sorted(room), 1):  # the level that the other records fill the emptiest n shards to
        level = (rest + sum(b for b, _ in sorted(room)[:n])) / n
        if n == shards or level <= sorted(room)[n][0]:
            break
    ends, at = [], 0.0
    for k in range(shards):
        at += max(0.0, level - by_shard[k])
        ends.append(at)
    return home, ends
