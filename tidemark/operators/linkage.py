"""Record linkage: blocking, scoring, decisions and entity assignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_similarity


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the matching rules."""

    text: float = 0.9
    time: float = 0.5
    time_alone: float = 0.8
    text_low: float = 0.5
    cosine: float = 0.88
    rerank: float = 0.95
    undated: float = 0.9
    undated_low: float = 0.7


def decide(text: Column, time: Column, cosine: Column, undated: Column, t: Thresholds = Thresholds()) -> Column:
    """What to do with a pair: ``merge``, ``new`` or ``uncertain``, and by which rule, as ``decision:rule``."""
    far = cosine.isNull() | (cosine < t.cosine)
    return (
        F.when(undated & (text >= t.undated), "merge:undated-text").when(undated & (text < t.undated_low), "new:undated-low-text").when(undated, "uncertain:")
        .when((text >= t.text) & (time >= t.time), "merge:text-time").when(time >= t.time_alone, "uncertain:")
        .when((text < t.text_low) & far, "new:different").otherwise("uncertain:")
    )


def decide_after_rerank(p: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(p.isNull(), "new:judge-unavailable").when(p >= t.rerank, "merge:rerank-yes").otherwise("new:rerank-no")


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors; null where one is empty, their lengths differ, or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


#: Vectors of one block that are compared at once: known ones, and those asked about.
KNOWN, ASKED = 4096, 1024


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and doubles of the vectors of each length, but for those that are null, empty or hold null."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(at)).flatten()
        doubles = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).all(axis=1)
        out[int(size)] = at[whole], doubles[whole]
    return out


def _rounded(q: np.ndarray, e: np.ndarray, digits: int) -> np.ndarray:
    """Cosines times ten to ``digits``, rounded half up; infinite where not a number (which sorts first), -1e300 where null."""
    with np.errstate(all="ignore"):
        norms = np.sqrt(np.multiply.outer((q * q).sum(axis=1), (e * e).sum(axis=1)))
        x = q @ e.T / norms * 10.0**digits
        x = np.copysign(np.floor(np.abs(x) + 0.5), x)
        odd = ~np.isfinite(q).all(axis=1)[:, None] | ~np.isfinite(e).all(axis=1)[None, :]
        return np.where(odd | np.isnan(norms), np.inf, np.where(norms > 0, np.where(np.isnan(x), np.inf, x), -1e300))


def nearest(known: DataFrame, asked: DataFrame, block: str, most: int, digits: int = 5) -> DataFrame:
    """(a, b, cosine): for every (a, block, v) asked about, the ``most`` other (b, block, v) known ones of its block with the highest rounded
    cosine, ties to the smaller ``b``.

    Both sides of a block are dealt into parts of bounded size, and each part of the one meets each of the other as matrices in a task, which
    returns its best. All pairs of a block are compared; what is shuffled is each part once for each part of the other side.
    """
    known, asked = known.where(F.col(block).isNotNull() & F.col("b").isNotNull()), asked.where(F.col(block).isNotNull() & F.col("a").isNotNull())
    parts = lambda rows, size, name: rows.groupBy(block).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    many = parts(known, KNOWN, "_nk").join(parts(asked, ASKED, "_nq"), block)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ks = known.join(many, block).select(F.col(block).alias("block"), dealt("b", "_nk").alias("k"), each("_nq").alias("q"), F.lit(False).alias("asks"), F.col("b").alias("id"), "v")
    qs = asked.join(many, block).select(F.col(block).alias("block"), each("_nk").alias("k"), dealt("a", "_nq").alias("q"), F.lit(True).alias("asks"), F.col("a").alias("id"), "v")

    def best(part: pa.Table) -> pa.Table:
        known = part.filter(pc.invert(part["asks"])).select(["id", "v"]).sort_by("id").combine_chunks()
        asked = part.filter(part["asks"]).select(["id", "v"]).combine_chunks()
        none = pa.table({"a": pa.array([], "int64"), "b": pa.array([], "int64"), "cosine": pa.array([], "float64")})
        if not known.num_rows or not asked.num_rows:
            return none
        ids, vectors, out = known["id"].to_numpy(), _by_length(known["v"].combine_chunks()), [none]
        names, wanted = asked["id"].to_numpy(), _by_length(asked["v"].combine_chunks())
        for start in range(0, asked.num_rows, 256):
            here = names[start : start + 256]
            score = np.full((len(here), len(ids)), -1e300)  # null unless told otherwise
            for size, (at, q) in wanted.items():
                if size in vectors:
                    inside = (at >= start) & (at < start + 256)
                    score[np.ix_(at[inside] - start, vectors[size][0])] = _rounded(q[inside], vectors[size][1], digits)
            score[here[:, None] == ids[None, :]] = -np.inf  # no pair
            rows = np.arange(len(here))
            for _ in range(most):
                top = score.argmax(axis=1)  # the first of equals, so the smallest id
                s = score[rows, top]
                is_pair, value = s > -np.inf, np.where(s == np.inf, np.nan, s / 10.0**digits) + 0.0
                found = pa.array(value[is_pair], mask=(s == -1e300)[is_pair], from_pandas=False)
                out.append(pa.table({"a": here[is_pair], "b": ids[top][is_pair], "cosine": found}))
                score[rows, top] = -np.inf
        return pa.concat_tables(out)

    found = ks.unionByName(qs).groupBy("block", "k", "q").applyInArrow(best, "a long, b long, cosine double")
    ranked = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    return found.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= most).drop("_r")


def title_pairs(titles: DataFrame, block: list[str]) -> DataFrame:
    """(a, b, score) of different titles in one block.

    Equal titles are one title here: rows are (name, title, *block), ``name`` the smallest id of a title, so a title
    that many rows share meets the others once. A block should hold a day, so that it does not grow with the library.
    """
    keyed = titles.groupBy(*block, "title").agg(F.min("name").alias("name"))
    a, b = keyed.alias("a"), keyed.alias("b")
    on = F.col("a.name") < F.col("b.name")
    for k in block:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), title_similarity(F.col("a.title"), F.col("b.title")).alias("score"))


def assign(findings: DataFrame, block: list[str], t: Thresholds = Thresholds()) -> DataFrame:
    """(finding, item) of events by ``reconcile``, each finding a picture of its own.

    Rows are (*block, at, seq, finding, title, start, all_day), times in microseconds; titles are normalised.
    """
    from .reconcile import reconciled

    name = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in block])
    one = F.lit(None).cast("string")
    rows = findings.select(
        one.alias("library"), name.alias("context"), F.lit("event").alias("family"), F.lit("").alias("day"), F.lpad(F.col("seq").cast("string"), 20, "0").alias("image"), "at", F.lit(0).alias("n"), one.alias("window"),
        "finding", "title", "start", F.lit(None).cast("long").alias("end"), "all_day", F.lit(False).alias("inferred"),
    )
    return reconciled(rows, t=t).select(F.col("finding").cast("long").alias("finding"), F.col("item").cast("long").alias("item"))
