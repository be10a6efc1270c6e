"""The streaming side: notices, debouncing, retries and incremental counts.

Each operator has one definition for batch tables and Structured Streaming: the sequential rule is a small function
over one key's sorted times and its carried state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values, in microseconds: quiet time and ceiling of a notice, the leading debounce, waits between attempts.
QUIET, CEILING, DEBOUNCE, WAITS = 20_000_000, 120_000_000, 300_000, (10_000_000, 60_000_000)
#: Attempts before a job fails for good.
MOST_ATTEMPTS = 3


def accept(times: list[int], last: int | None, least: int) -> tuple[list[bool], int | None]:
    """Leading-edge debounce: a time is accepted if it is ``least`` or more after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= least
        out.append(ok)
        last = t if ok else last
    return out, last


def notices(times: list[int], quiet: int, ceiling: int) -> list[tuple[int, int, int]]:
    """(first, fires, count): a notice fires after ``quiet`` without news, at most ``ceiling`` after its first item."""
    out: list[list[int]] = []
    for t in times:
        if out and t <= out[-1][1]:
            out[-1][1], out[-1][2] = min(t + quiet, out[-1][0] + ceiling), out[-1][2] + 1
        else:
            out.append([t, min(t + quiet, t + ceiling), 1])
    return [tuple(x) for x in out]


def debounced(rows: DataFrame, key: str, at: str, order: str, least: int = DEBOUNCE) -> DataFrame:
    """The accepted rows of a batch table; keys stream sorted through the tasks, one time is carried."""
    ordered = rows.select(key, at, order).repartition(key).sortWithinPartitions(key, at, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, None
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch[at], strict=True):
                if k != who:
                    who, last = k, None
                (ok,), last = accept([t], last, least)
                keep.append(ok)
            yield batch[keep]

    return ordered.mapInPandas(run, ordered.schema)


def debounced_stream(stream: DataFrame, key: str, least: int = DEBOUNCE) -> DataFrame:
    """The same over a stream of (key long, t long) rows; the last accepted time is the state.

    Rows of a micro-batch are taken in order of time; a row that comes after a later one was accepted is dropped.
    """

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for batch in batches for t in batch["t"].tolist())
        ok, last = accept(times, last, least)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: name[0], "t": [t for t, good in zip(times, ok, strict=True) if good]})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def notice_windows(rows: DataFrame, key: str, at: str, quiet: int = QUIET, ceiling: int = CEILING) -> DataFrame:
    """(key, first, fires, n) of a batch table; keys stream sorted through the tasks, one open notice is carried."""
    ordered = rows.select(key, at).repartition(key).sortWithinPartitions(key, at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, open_ = None, None
        for batch in batches:
            out = []
            for k, t in zip(batch[key].tolist(), batch[at].tolist(), strict=True):
                if open_ and k == who and t <= open_[1]:
                    open_ = [open_[0], min(t + quiet, open_[0] + ceiling), open_[2] + 1]
                else:
                    if open_:
                        out.append((who, *open_))
                    who, open_ = k, [t, min(t + quiet, t + ceiling), 1]
            yield pd.DataFrame(out, columns=[key, "first", "fires", "n"])
        if open_:
            yield pd.DataFrame([(who, *open_)], columns=[key, "first", "fires", "n"])

    return ordered.mapInPandas(run, f"{key} long, first long, fires long, n long")


def counted(rows: DataFrame) -> DataFrame:
    """Events by hour and type: the same plan for a table and for a stream."""
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_end(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now, its result kept as Parquet below ``path``."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
