"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5
#: A key with over so many rows, and over total rows / HOT_KEYS, is hot: there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 2_000, 10_000
#: Rows of a narrow table that is sent to all tasks instead of being joined by a shuffle.
SENT_ROWS = 200_000
#: Bits that tell which rows can have a partner in a table that is too large to be sent (8 MB, whatever its size).
TOLD_BITS = 1 << 26
#: Whole texts that Python gets at a time at most, where a stage hands over all of them.
TEXTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset (tests on one machine) a folder of our own is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets go of shuffles and kept tables that nothing refers to any more: Spark deletes them when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def dealt_by_size(spark: SparkSession, rows: int, each: int = 50_000) -> Iterator[int]:
    """Within it, shuffles of a table of so many narrow rows go to no more partitions than these need; large tables as ever."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    few = max(1, min(int(usual), math.ceil(rows / each)))
    spark.conf.set("spark.sql.shuffle.partitions", str(few))
    try:
        yield few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def texts_in_small_batches(spark: SparkSession) -> None:
    """From now on Python gets rows in batches of ``TEXTS`` at most: both sides hold a batch of whole texts several times, outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = int(spark.conf.get(name))
    if usual <= 0 or usual > TEXTS:
        spark.conf.set(name, str(TEXTS))


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def text_key(text: Column) -> Column:
    """With a document's id this tells its row from all but equal ones, in every scan of the table alike."""
    return F.xxhash64(text, F.length(text))


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df``, a kept narrow table, marked for a broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def perhaps_in(rows: DataFrame, some: DataFrame, on: dict[str, str], out: str) -> DataFrame:
    """Adds ``out``: false only where none of ``some``, by its columns ``on`` the right, has what the row has in those on the left.

    Tasks get a bitmap of fixed size, in pieces of 4 KB that are made where the rows of ``some`` are grouped.
    """
    slot = lambda names: F.pmod(F.xxhash64(*names), F.lit(TOLD_BITS)) + 1
    bits = some.select(slot(on.values()).alias("_ph_s")).groupBy(F.bitmap_bucket_number("_ph_s").alias("_ph_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_ph_s")).alias("_ph_bits"))
    placed_rows = rows.withColumn("_ph_at", slot(on.keys()))
    met = placed_rows.join(F.broadcast(bits), F.bitmap_bucket_number("_ph_at") == F.col("_ph_b"), "left")
    at = F.bitmap_bit_position("_ph_at")
    byte = F.conv(F.hex(F.substring("_ph_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.select(*rows.columns, F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(out))


def met_with(rows: DataFrame, some: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner``) with the matching rows of ``some``, a kept narrow table, or those without any (``left_anti``); nulls match nulls.

    A large ``some`` is joined by a shuffle, but only of the rows that can match: the others stay where they are.
    """
    same = F.lit(True)
    for a, b in on.items():
        same = same & F.col(a).eqNullSafe(F.col(b))
    if some.count() <= SENT_ROWS:
        return rows.join(F.broadcast(some), same, how)
    told = perhaps_in(rows, some, on, "_mw_may")
    found = told.where("_mw_may").drop("_mw_may").join(some, same, how)
    return found if how == "inner" else told.where("not _mw_may").drop("_mw_may").unionByName(found)


def looked_up(rows: DataFrame, small: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` left-joined with ``small``, which has a row for each key, its values, and ``n``, how many rows have the key.

    Rows of hot keys meet a broadcast of those keys, of which there are few by their sizes; only the others are shuffled.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    values = [c for c in small.columns if c not in (key, n)]
    hot = small.where(F.col(n) > limit).select(key, *values, F.lit(True).alias("_lu_hot"))
    met = rows.join(F.broadcast(hot), key, "left")
    cold = met.where(F.col("_lu_hot").isNull()).select(*rows.columns).join(small.where(F.col(n) <= limit).drop(n), key, "left")
    return met.where("_lu_hot").select(*rows.columns, *values).unionByName(cold.select(*rows.columns, *values))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_totals(df: DataFrame, group: list[str], bucket: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds each of ``sums``' names: the sum of its value over all rows of the group up to and including this one.

    Rows are ordered by ``bucket`` columns, then by ``order`` columns. Only rows of one bucket meet in one
    task; groups of any size are carried over their buckets' subtotals. Groups and buckets may be null.
    """
    keys = group + bucket
    part = df.groupBy(*keys).agg(*[F.sum(value).alias(f"_rt_sum_{out}") for out, value in sums.items()])
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        *[F.col(k).alias(f"_rt_{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_rt_sum_{out}").over(before), F.lit(0)).alias(f"_rt_before_{out}") for out in sums],
    )
    same = [df[k].eqNullSafe(part[f"_rt_{i}"]) for i, k in enumerate(keys)]
    joined = df.join(part, same, "left").drop(*[f"_rt_{i}" for i in range(len(keys))])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for out, value in sums.items():
        joined = joined.withColumn(out, F.col(f"_rt_before_{out}") + F.sum(value).over(within))
    return joined.drop(*[f"_rt_before_{out}" for out in sums])


def running_total(df: DataFrame, group: list[str], bucket: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, group, bucket, order, {out: value})


def placed(df: DataFrame, order: list[str], out: str = "at", only: list[str] | None = None) -> DataFrame:
    """``df`` (or ``only`` some columns), kept, with ``out``: each row's place from 0 in the order of columns (null first).

    Rows are dealt by ranges of the order, rows equal in it by where they stood, so no range has to hold one group;
    each range is numbered by itself and moved on by the sizes of those before it, of which there is one a partition.
    """
    spark = df.sparkSession
    keys = [*order, "_pc_tie"]
    dealt = df.withColumn("_pc_tie", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    kept = settled(dealt.select(*(only or df.columns), F.monotonically_increasing_id().alias("_pc_row")))
    part = F.shiftright("_pc_row", 33)
    sizes = kept.groupBy(part.alias("_pc_part")).agg(F.count("*").alias("_pc_n"))
    before = sizes.select("_pc_part", (F.sum("_pc_n").over(Window.orderBy("_pc_part")) - F.col("_pc_n")).alias("_pc_before"))
    met = kept.withColumn("_pc_part", part).join(F.broadcast(before), "_pc_part")
    return met.withColumn(out, F.col("_pc_before") + F.col("_pc_row").bitwiseAND((1 << 33) - 1)).drop("_pc_part", "_pc_before", "_pc_row")
