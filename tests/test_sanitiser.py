"""Sensitive strings in large numbers: each line is judged as a plain search judges it."""

import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.operators.reading import CUT, KEYED, loggable
from tidemark.plans import catalogue


def left(lines, strings):
    return sorted(r.k for r in loggable(lines, "t", strings, "s", most=0).collect())


def test_strings_that_begin_alike_make_no_pairs(spark):
    n = 100_000
    lines = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("start"), F.col("id").cast("string"), F.lit(".")).alias("t"))
    strings = spark.range(n, 2 * n).select(F.concat(F.lit("start"), F.col("id").cast("string"), F.lit(".")).alias("s")).union(spark.createDataFrame([("T99999.",)], "s string"))
    began = time.monotonic()
    assert left(lines, strings) == list(range(n - 1))
    assert time.monotonic() - began < 60  # 10,000 million pairs begin alike


def test_long_strings_long_words_and_blanks(spark):
    url = "https://example.org/" + "deep/" * 20
    giant = "".join(chr(0x4E00 + k % 5000) for k in range(3 * CUT + 7))
    texts = [url + "a", url + "b", "x" + url, giant, giant[: CUT + 30], giant[CUT + 40 :], "two words here", "two  words", "Z", "", "ends " + url[-KEYED:], "İx", None]
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    at = giant[CUT - 20 : CUT + 20]
    for strings in ([url + "A"], [url], [at], [giant[2 * CUT - KEYED - 5 : 2 * CUT + KEYED]], ["wo w", "q"], ["two words", url + "b"], ["z", giant], ["absent", "x" * 70, "deep/x"], [url[-KEYED:]], ["i̇x"]):
        bad = spark.createDataFrame([(s,) for s in strings], "s string")
        want = [r.k for r in lines.select("k", F.lower("t").alias("t")).collect() if r.t is not None and not any(s.lower() in r.t for s in strings)]
        assert left(lines, bad) == want, strings


def test_words_of_single_documents(spark, tmp_path):
    rows = [(1, "One two\nthree one"), (2, "two THREE fourfive\nseven"), (2, "again again"), (3, "four\nonly xfourfivex"), (3, None), (None, "nobody\nfour"), (4, "three onl\nagain  three"), (5, "break\nbreak two")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(catalogue.ORACLES["log_sanitiser_words"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["log_sanitiser_words"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
