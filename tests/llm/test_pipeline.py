import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import decontaminate


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(9)
    words = [f"{a}{b}" for a in "river stone light garden walk slow green morning paper window".split() for b in ("", "s", "ed", "ly", "ing")]
    fresh = lambda n: [rnd.choice(words) + rnd.choice("abcdefghij") for _ in range(n)]
    docs, labels = [], []
    for k in range(300):
        text = fresh(rnd.randint(60, 120))
        if k % 5 == 0:
            text[5:5] = ["grumbo", "grumbos", "grumbola", "grumbo"]
        docs.append((k, " ".join(text), "en", f"s{k % 4}"))
        labels.append((k, 1, int(k % 5 == 0)))
    clean = [fresh(150) for _ in range(20)]
    docs += [(1000 + k, " ".join(t), "en", "s1") for k, t in enumerate(clean)]
    docs += [(2000 + k, " ".join(clean[k]), "en", None) for k in range(5)]  # copies
    docs += [(3000 + k, " ".join(clean[k][:70] + ["odd"] + clean[k][71:]), "en", "s2") for k in range(5, 10)]  # near copies
    docs += [(4000 + k, "grumbo grumbos " * 3 + " ".join(fresh(60)), "en", "s3") for k in range(5)]  # toxic
    item = " ".join(fresh(30))
    docs += [(5000, " ".join(fresh(50)) + " " + item, "en", "s0"), (6000, None, None, None), (6001, "", "en", "s0"), (6000, None, None, None)]
    return docs, labels, [(1, item), (2, "short one"), (3, None)]


def test_stages(spark, docs, stored, planted):
    rows, labels, items = planted
    clash = docs(rows)
    for name in ("_pl_id", "_pl_key", "_doc", "_id", "_key", "_mx_id", "_mx_n", "_mx_row", "_sh_key", "_sh_row", "_sh_at", "score", "copies", "key", "component", "_tx_e"):
        clash = clash.withColumn(name, F.lit("c"))
    sf = stored(documents=clash, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, now, sf)
        if k < len(P.STAGES) - 1:
            assert out.columns == now.columns
        out.write.parquet(f"{sf}/stage{k}")
        now = spark.read.parquet(f"{sf}/stage{k}")
        seen.append(Counter(r.doc_id for r in now.collect()))
    toxic, copies, benchmark, mixed, sharded = seen
    assert not {4000 + k for k in range(5)} & set(toxic) and {1000 + k for k in range(20)} <= set(toxic) and toxic[6000] == 2
    assert {1000 + k for k in range(20)} <= set(copies)
    assert not ({2000 + k for k in range(5)} | {3000 + k for k in range(5, 10)}) & set(copies)
    assert sum(copies[k] for k in (6000, 6001)) == 1  # texts without words are one group
    assert 5000 in copies and 5000 not in benchmark and set(benchmark) == set(copies) - {5000}
    assert set(mixed) <= set(benchmark) and max(mixed.values()) <= 2
    assert sharded == mixed


def test_decisions_agree_with_the_rule(spark):
    kind = "n_hit long, n_words long"
    rows = spark.createDataFrame([(1, 20), (1, 21), (0, 0), (5, 5)], kind)
    got = [r.c for r in rows.select(decontaminate.contaminated(rows.n_hit, rows.n_words).alias("c")).collect()]
    assert got == [True, False, False, True]


def test_stages_of_no_documents(spark, docs, stored):
    empty = docs([])
    sf = stored(documents=empty, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert P.run(spark, sf).count() == 0
