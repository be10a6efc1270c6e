from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def plain_targets(sizes, weights=(5, 2, 1), total=1.5):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    left, target, open_ = total * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > 2 * sizes[n]}
        if not over:
            return target | {n: level * weight[n] for n in open_}
        for n in over:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def test_targets_and_copies(spark, docs):
    rows = [(k, " ".join(["w"] * (1 + k * k % 37)), None, f"s{k % 7}" if k % 50 else None) for k in range(3000)] + [(9000 + k, "w w w w", None, "hot") for k in range(4000)]
    rows += [(-1, None, None, "empty"), (-2, "", None, "empty")]
    got = M.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    want = plain_targets(dict(sizes))
    for s, t in want.items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 80
    again = {(r.doc_id, r.copies) for r in M.mix(docs(rows[::-1]).repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_documents_repeat_and_keep_columns(spark, docs):
    rows = [(k, "a b c", "en", "x") for k in range(40)] + [(99, None, None, None)]
    named = docs(rows).withColumn("copies", F.lit(7)).withColumn("target", F.lit("t"))
    out = M.mixed_documents(named)
    assert out.columns == named.columns
    assert out.where("copies <> 7 or target <> 't'").count() == 0
    assert out.count() == sum(r.copies for r in M.mix(docs(rows)).collect()) == 60
    assert M.mix(docs([])).count() == 0
