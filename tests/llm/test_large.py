"""Paths that only large tables take."""

from pyspark.sql import functions as F

from tidemark.llm import common, toxicity


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_over_a_million_steps_are_tables(spark):
    """Documents' words are not shuffled for as many steps as 6 GB of documents have (some 3 million)."""
    step = F.concat(F.lit("a"), F.col("id").cast("string"))
    steps = spark.range(1_300_000).select(step.alias("step"), F.when(F.col("id") % 2 == 0, 0.5).alias("known"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(0.0).alias("unknown"))
    steps = steps.withColumn("seen", F.col("known").isNotNull()).withColumn("known", F.coalesce("known", F.lit(0.0)))
    held = toxicity.sent_if_few(steps)
    assert len(held.known.keys) == 650_000 and len(held.unknown.keys) == 433_334
    seen, value = held.known.at(toxicity.hashed(["a4", "a5", "b"]))
    assert seen.tolist() == [True, False, False] and value.tolist() == [0.5, 0, 0]
    assert held.unknown.at(toxicity.hashed(["a3", "a4"]))[1].tolist() == [0.25, 0]
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert exchanged(toxicity.score_documents(docs, toxicity.Model(held))) == 0


def test_many_labels_meet_words_not_texts(spark, monkeypatch):
    rows = [(k, None if k % 11 == 0 else f"word{k % 3} {'bad ' * (k % 2)}Word und {chr(0x4E00 + k)} {'x' * 90}") for k in range(200)] + [(None, "no id"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([(k, k % 2) for k in range(0, 200, 3)] + [(3, 0), (6, None), (9, 7), (999, 1), (None, 1)], "doc_id long, toxic int")
    found = []
    for most in (common.SENT_ROWS, 0):
        monkeypatch.setattr(toxicity, "SENT_ROWS", most)
        some = toxicity.labelled(docs, told)
        assert ("text" in some.columns) == (most > 0)
        found.append({r.word: (r.t, r.o) for r in toxicity.count_words(toxicity._usable(some)).collect()})
    assert found[0] == found[1] and found[0]


def test_only_rows_that_can_match_are_shuffled(spark, monkeypatch):
    rows = spark.range(5_000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"), F.lit("text").alias("text"))
    some = spark.range(0, 5_000, 3).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("x"), (F.col("id") % 7).alias("y")).distinct().cache()
    for how in ("inner", "left_anti"):
        want = sorted(common.met_with(rows, some, {"a": "x", "b": "y"}, how).select("a", "b").collect(), key=repr)
        with monkeypatch.context() as m:
            m.setattr(common, "SENT_ROWS", 0)
            assert sorted(common.met_with(rows, some, {"a": "x", "b": "y"}, how).select("a", "b").collect(), key=repr) == want and 1_000 < len(want) < 5_000
    told = common.perhaps_in(rows, some, {"a": "x", "b": "y"}, "may").groupBy("may").count().collect()
    hits = common.met_with(rows, some, {"a": "x", "b": "y"}).count()
    assert hits <= {r.may: r["count"] for r in told}[True] <= hits + 5
