from collections import defaultdict

from tidemark.llm import sharding as S


def check(rows, shards):
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += len((r.text or "").encode()) + 8
    assert all(0 <= k < shards for k in slots)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_even_and_gapless(spark, docs, monkeypatch):
    rows = [(k, f"text {k} " * (1 + k % 9)) for k in range(2000)] + [(5000 + k, "the same text again") for k in range(1500)] + [(1, None), (1, None), (None, ""), (7, "é")]
    df = docs(rows)
    out = S.assign_shards(df, 6).collect()
    assert len(out) == len(rows)
    size = check(out, 6)
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 6
    again = {(r.doc_id, r.text, r.shard, r.slot) for r in S.assign_shards(docs(rows[::-1]).repartition(3), 6).collect()}
    assert again == {(r.doc_id, r.text, r.shard, r.slot) for r in out}
    monkeypatch.setattr(S, "SAMPLED", 1)  # a poor sample: ranges are overfull at first
    assert check(S.assign_shards(df, 6).collect(), 6)


def test_equal_texts_stay_together(spark, docs):
    out = S.assign_shards(docs([(k, f"t{k % 700}") for k in range(2800)]), 4).collect()
    shards = defaultdict(set)
    for r in out:
        shards[r.text].add(r.shard)
    assert all(len(v) == 1 for v in shards.values())


def test_groups_of_any_size_below_a_shard_stay_whole(spark, docs):
    rows = [(k, f"alone {k}") for k in range(3000)] + [(10_000 + 400 * g + k, f"group {g} " * 3) for g in range(8) for k in range(5 + 30 * g)] + [(50_000 + k, "pair") for k in range(2)]
    out = S.assign_shards(docs(rows), 6).collect()
    size, shards = check(out, 6), defaultdict(set)
    for r in out:
        shards[r.text].add(r.shard)
    assert all(len(v) == 1 for v in shards.values())
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 6
    hot = S.assign_shards(docs(rows + [(90_000 + k, "more than a shard") for k in range(4000)]), 6).collect()
    size, shards = check(hot, 6), defaultdict(set)
    for r in hot:
        shards[r.text].add(r.shard)
    assert {t for t, v in shards.items() if len(v) > 1} == {"more than a shard"}
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 6


def test_a_text_larger_than_a_shard(spark, docs):
    out = S.assign_shards(docs([(k, "x" * 50) for k in range(10)] + [(99, "y" * 10_000)]), 4).collect()
    assert sorted(check(out, 4))[-1] <= 3 and len(out) == 11


def test_few_rows(spark, docs):
    assert S.assign_shards(docs([]), 4).count() == 0
    (row,) = S.assign_shards(docs([(3, "x")]), 4).collect()
    assert row.slot == 0 and 0 <= row.shard < 4
