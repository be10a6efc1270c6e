"""The stored index: blocks of postings of any size give what a plain count of the documents' words gives."""

import math
import random

import pytest

from tidemark.operators import search

FIELDS = {"title": ("title", 3.0), "body": ("body", 1.0)}


def documents(spark, n=60):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(["of", "the", "offer", "of", "the", "offer", "of", "the", "Été", "was", "x1", "sea"]) for _ in range(rng.randrange(k)))
    rows = [(k, text(4), text(20)) for k in range(n)] + [(900, None, "of the sea"), (901, "sea", None), (902, "", ""), (None, "of the", "offer")]
    return rows, spark.createDataFrame(rows, "id long, title string, body string")


def plain(rows, phrase, prefix, excluded):
    """(doc, score) of documents with the phrase and a word that begins with ``prefix``, and without the excluded word."""
    split = [(d, [[w.lower().replace("é", "e") for w in (f or "").split()] for f in fields]) for d, *fields in rows]
    pairs = lambda ws: sum(tuple(ws[i : i + len(phrase)]) == phrase for i in range(len(ws)))
    tf = {d: tuple(sum(w * count(f) for w, f in zip((3.0, 1.0), fs, strict=True)) for count in (lambda ws: sum(x.startswith(prefix) for x in ws), pairs)) for d, fs in split}
    n, mean, out = len(split), sum(len(f) for _, fs in split for f in fs) / len(split), {}
    df = [sum(t[k] > 0 for t in tf.values()) for k in (0, 1)]
    for d, fs in split:
        if d is not None and all(tf[d]) and not any(excluded in f for f in fs):
            idf = [max(math.log((n - x + 0.5) / (x + 0.5)), 1e-6) for x in df]
            out[d] = sum(i * t * (search.K1 + 1) / (t + search.K1 * (1 - search.B + search.B * sum(map(len, fs)) / mean)) for i, t in zip(idf, tf[d], strict=True))
    return out


@pytest.mark.parametrize("met", [2_000_000, 30, 1])
def test_blocks_of_postings(spark, tmp_path, monkeypatch, met):
    monkeypatch.setattr(search, "MET", met)
    rows, docs = documents(spark)
    search.write_index(docs.coalesce(1), "id", FIELDS, f"{tmp_path}/i")
    found = search.Index(spark, f"{tmp_path}/i").search(search.parse('"of the" -was off'))
    want = plain(rows, ("of", "the"), "off", "was")
    assert want and {r.doc: round(r.score, 9) for r in found.collect()} == {d: round(s, 9) for d, s in want.items()}


def test_a_word_is_stored_once_for_many_documents(spark, tmp_path):
    """One row for each word and field of a task's documents, not one for each document: so much less is shuffled and written."""
    _, docs = documents(spark)
    search.write_index(docs.coalesce(1), "id", FIELDS, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/postings").where("token <> ''").count() <= 2 * 7


def test_an_empty_index(spark, tmp_path):
    _, docs = documents(spark)
    search.write_index(docs.where("id < 0"), "id", FIELDS, f"{tmp_path}/i")
    assert search.Index(spark, f"{tmp_path}/i").search(search.parse("of the")).count() == 0
