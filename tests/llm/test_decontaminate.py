import re

from tidemark.llm import decontaminate as D

A = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))


def split(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(A, A.lower()))) if w]


def plain(docs, items, window=13):
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, item_text in items:
            want = split(item_text)
            size = min(window, len(want))
            if item is None or not size:
                continue
            windows = {tuple(want[s : s + size]) for s in range(len(want) - size + 1)}
            for s in range(len(words) - size + 1):
                if tuple(words[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found.add(str(item))
        out.append((doc, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs_rows, items_rows, **kw):
    docs = spark.createDataFrame(docs_rows, "doc_id long, text string")
    items = spark.createDataFrame(items_rows, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in D.find_contamination(docs, items, **kw).collect()), key=str)


def test_like_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(40))
    docs = [
        (1, "x " + " ".join(f"W{k}" for k in range(5, 25)) + " y"), (2, " ".join(f"w{k}" for k in range(5, 17))), (3, None), (4, ""), (5, "one two, THREE one two three"),
        (5, "one two, THREE one two three"), (6, long + " " + long), (None, "one two three"), (7, "the the the the"), (8, "Été d'été 12 été"), (9, "..."),
    ]
    items = [(10, long), (2, "one two three"), (3, "the the"), (4, None), (5, "!!"), (None, "one"), (10, "été 12"), (11, long)]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, block_words=20) == plain(docs, items)
    assert run(spark, docs, items, window=3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, ())]
