"""Queries against their SQL on rows that the given tables hold rarely or not at all."""

import datetime as dt
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.operators import actions, reading, search
from tidemark.plans import actions as plans
from tidemark.plans import catalogue


def compared(spark, folder, name, **tables):
    """The query's rows and those of its SQL, sorted, over tables written below ``folder``."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.table(rows), f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = con.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    return sorted(map(tuple, got.collect()), key=repr), sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def events(times, users=None):
    n = len(times)
    kinds = ["view", "click", "error"]
    return {"event_id": pa.array(range(n), pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array(users or [k % 7 for k in range(n)], pa.int64()), "event_type": [kinds[k % 3] for k in range(n)], "value": [1.0] * n, "props": ["{}"] * n}


def test_half_seconds(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    got, want = compared(spark, tmp_path, "assembled_findings", events=events([start + dt.timedelta(seconds=k, microseconds=500_000) for k in range(18)]))
    assert len(got) == 18 and got == want


def test_month_entries_above_all_cells(spark, tmp_path):
    label = [(25 * (k + 1), k, 3) for k in range(7, 42)]  # no label in the first row
    high = [(25 * k + 5, 42 * k + 1, 1) for k in range(5)] + [(25 * k + 5, 42 * k + 30, 1) for k in range(5, 9)]
    orders, parts, numbers = zip(*label, *high, strict=True)
    n, day = len(orders), dt.datetime(2024, 1, 1)
    rows = {"l_orderkey": pa.array(orders, pa.int64()), "l_partkey": pa.array(parts, pa.int64()), "l_suppkey": pa.array([13] * n, pa.int64()), "l_linenumber": pa.array(numbers, pa.int32()), "l_shipdate": pa.array([day] * n, pa.timestamp("us"))}
    got, want = compared(spark, tmp_path, "month_entries", lineitem=rows)
    assert got == want and {r[4] is None for r in got} == {True, False}


def test_field_of_lines_without_part_or_flag(spark, tmp_path):
    n, day = 210, dt.datetime(2024, 1, 1)
    flags, parts = ["N", "A", None, "R", None], [1, None, 3]
    rows = {"l_orderkey": pa.array([k // 4 for k in range(n)], pa.int64()), "l_partkey": pa.array([parts[k % 3] for k in range(n)], pa.int64()), "l_linenumber": pa.array([k % 4 for k in range(n)], pa.int32()), "l_returnflag": [flags[k % 5] for k in range(n)], "l_shipdate": pa.array([day + dt.timedelta(days=k % 7) for k in range(n)], pa.timestamp("us"))}
    got, want = compared(spark, tmp_path, "field_survivorship", lineitem=rows)
    assert got == want and {r[1] is None for r in got} == {True, False} == {r[2] == "read" for r in got}


def test_states_before_in_a_long_log(spark, tmp_path):
    n, start = 20_000, dt.datetime(2024, 1, 1)
    rows = events([start + dt.timedelta(seconds=k) for k in range(n)], [None if k % 50 == 0 else 300 * (k % 3) for k in range(n)])  # one item has nearly all
    began = time.monotonic()
    got, want = compared(spark, tmp_path, "states_before", events={k: v.slice(0, 2000) if isinstance(v, pa.Array) else v[:2000] for k, v in rows.items()})
    assert got == want
    pq.write_table(pa.table(rows), f"{tmp_path}/events.parquet")
    log = plans.log_of(spark, str(tmp_path)).orderBy("op").collect()
    undone, live, told = {}, [], {}
    for r in reversed(log):
        if r.kind == "undo":
            undone[r.undoes] = r.op
    for r in log:
        live = [x for x in live if undone.get(x.op, n) > r.op]
        last = live[-1] if live and r["item"] is not None else None
        told[r.op] = ({"dismiss": "dismissed", "merge": "merged"}.get(last and last.kind, "active"), last.other if last and last.kind == "merge" else None)
        live += [r] if r.kind in actions.STATUS and r["item"] is not None else []
        live = live[-64:]  # an undo reaches back four operations
    assert {r.op: (r.status, r.merged_into) for r in catalogue.QUERIES["states_before"](spark, str(tmp_path)).collect()} == told
    assert time.monotonic() - began < 120


def test_terms_of_rows_with_one_id(spark):
    rows = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "c c d"), (None, "d"), (None, "d e"), (3, None)], "doc long, text string")
    got = {r.token: (r.n, r.docs) for r in search.term_counts(rows, "doc", "text").collect()}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (3, 2), "d": (3, 1), "e": (1, 0)}


def test_sensitive_strings_are_not_sent(spark):
    lines = spark.range(2_000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    strings = spark.range(1_500).select(F.concat(F.lit("E "), F.col("id").cast("string")).alias("x"))
    left = reading.loggable(lines, "line", strings, "x")
    held = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in held and "SortMergeJoin" in held
    assert sorted(int(r.line[5:]) for r in left.collect()) == [k for k in range(2_000) if not any(f"e {s}" in f"line {k}" for s in range(1_500))]
