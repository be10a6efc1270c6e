"""Every registered query on one small folder with nulls, empty texts, ties, repeats and clashing columns, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_simhash import plain_fingerprint, plain_groups
from tokenizers import Tokenizer

from tidemark.llm import queries as Q
from tidemark.llm import toxicity

LANGS = {"aa": "lorem ipsum dolor amet elit sed", "bb": "jeg hedder ikke hvad hvor naar", "cc": "привет мир это слово язык день"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, rows = random.Random(11), []
    for k in range(240):
        lang = rnd.choice(list(LANGS))
        text = " ".join(rnd.choice(LANGS[lang].split()) + rnd.choice(["", "a", "o"]) for _ in range(rnd.choice([3, 20, 60])))
        if k % 6 == 0:
            text += " grumbo grumbola"
        rows.append((k, text, lang if k % 10 else None, f"s{k % 4}" if k % 9 else None))
    rows += [(300 + k, rows[3][1], "aa", "s0") for k in range(30)] + [(400, None, "aa", None), (401, "", None, "s1"), (401, "", None, "s1"), (None, "Lorem  IPSUM\t12", "aa", "s1"), (402, "12 !? 😀", "bb", "s2"), (7, "other text of a known id", None, "hot")]
    rows += [(500, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " + "x " * 40, "aa", "s0"), (501, "Short ITEM, here", "aa", "s0"), (502, "lorem " * 30_000, "aa", "s3")]
    path = str(tmp_path_factory.mktemp("small"))
    clash = {"score": 1, "shard": "x", "slot": 2, "size": "big", "key": 3, "row": 4, "predicted": 5, "n_tokens": 6, "component": 7, "_li": 8, "_sh_key": 9, "_mx_n": 10, "_row": 11, "copies": 12, "name": "n"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name, value in clash.items():
        docs = docs.withColumn(name, F.lit(value))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("grumbo" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 7 < 6] + [(9999, 0, 1), (5, None, None), (6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("no")).write.parquet(f"{path}/labels.parquet")
    items = [("a", " ".join(rows[-3][1].split()[:14])), ("b", "short item"), ("c", None), ("d", "..."), ("a", "short item"), (None, "lorem"), ("b,c", "here")]
    spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


def against_sql(spark, path, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    want = con.sql(Q.ORACLES[name])
    rows = Q.QUERIES[name](spark, path).select(*want.columns).collect()
    plain = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(rows) == plain(want.fetchall())


def test_op1(spark, folder):
    path, rows = folder
    out = Q.op1_language_id(spark, path).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        text = (texts[r.doc_id] or "").lower()
        if not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
        elif r.doc_id is not None and r.doc_id < 240 and r.doc_id != 7 and len(text.split()) >= 20:  # a plain count of known words agrees
            votes = {lang: sum(any(w.startswith(x) for x in known.split()) for w in text.split()) for lang, known in LANGS.items()}
            assert r.lang_pred == max(votes, key=votes.get)


def test_op3(spark, folder):
    against_sql(spark, folder[0], "op3_mix_sources")


def test_op4(spark, folder):
    path, rows = folder
    out = Q.op4_toxicity(spark, path).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    told = [(r.predicted, "grumbo" in dict((x[0], x[1] or "") for x in rows)[r.doc_id]) for r in out if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 7]
    assert sum(p == t for p, t in told) >= 0.98 * len(told)


def plain_model(counts):
    """Evidence of a word from the definition: every letter after the nine before it, steps of less than LEAST as none."""
    def steps(word):
        whole = toxicity.START + word + toxicity.END
        return [whole[max(0, k - toxicity.ORDER) : k + 1] for k in range(1, len(whole))]

    n, kinds, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
    for w, pair in counts.items():
        for step in steps(w) if sum(pair) >= toxicity.LEAST_DOCUMENTS else ():
            for c in (0, 1):
                n[step][c] += pair[c]
    for step, pair in n.items():
        for c in (0, 1):
            kinds[step[:-1]][c] += pair[c] > 0
            total[step[:-1]][c] += pair[c]
        kinds[step[:-1]][2] += 1
    letters, d, a = len({step[-1] for step in n}), toxicity.DISCOUNT, toxicity.SHARED

    def evidence(step):
        h = step[:-1]
        if h not in total:
            return 0.0
        rest = [(d * kinds[h][c] + a) / (total[h][c] + a) for c in (0, 1)]
        if step not in n:
            return math.log(rest[0]) - math.log(rest[1])
        pooled = (max(sum(n[step]) - d, 0) + d * kinds[h][2] / letters) / sum(total[h])
        p = [max(n[step][c] - d, 0) / (total[h][c] + a) + rest[c] * pooled for c in (0, 1)]
        return math.log(p[0]) - math.log(p[1])

    return lambda word: sum(e for e in map(evidence, steps(word)) if abs(e) >= toxicity.LEAST)


def made_counts():
    rnd = random.Random(4)
    counts = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))): [rnd.randint(0, 400), rnd.randint(0, 400)] for _ in range(60)}
    return counts | {"extremelyvicious": [300, 0], "extremelyhelpful": [0, 300], "bababab": [1, 0]}


def test_op4_model_is_its_definition(spark):
    counts = made_counts()
    rows = spark.createDataFrame([(toxicity.START + w + toxicity.END, *pair) for w, pair in counts.items()], "word string, t long, o long")
    steps = toxicity.spelling_steps(rows).cache()
    model, plain = toxicity.Model(toxicity._table(steps)), plain_model(counts)
    words = [*counts, "a", "zz", "abcabcabcabcabc", "cc", "extremelyvi", "extremelynew"]
    found = dict(zip(words, model.word_evidence([toxicity.START + w + toxicity.END for w in words]), strict=True))
    for word, got in found.items():
        assert got == pytest.approx(plain(word), abs=1e-4), word
    assert found["extremelyvicious"] > 1 and found["extremelyhelpful"] < -1
    texts = [" ".join(random.Random(k).choices(words, k=k)) for k in range(1, 120, 7)] + [None, "", "12", "x" * 500, "extremelyvicious" * 30]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id int, text string").withColumn("word", F.lit(1)).withColumn("a", F.lit(2))
    sent, joined = ({(r.doc_id, r.text): r.evidence for r in toxicity.evidence_of(docs, toxicity.Model(x)).collect()} for x in (model.steps, steps))
    assert sent.keys() == joined.keys()
    for key, value in sent.items():
        assert joined[key] == pytest.approx(value, abs=1e-4), key
    assert toxicity.score_documents(docs, toxicity.Model(steps)).count() == 2 * len(texts)


def test_op4_reads_runs_without_blanks_whole():
    run = "".join(random.Random(1).choice("abcd") for _ in range(205))
    read = [g[-1] for event in toxicity.events(f"x {run}9y") for g in toxicity.grams(event)]
    assert "".join(read) == f"x{toxicity.END}{run}{toxicity.END}y{toxicity.END}"


def test_op5(spark, folder):
    path, rows = folder
    out, texts = Q.op5_shard(spark, path).collect(), Counter((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8) for r in rows)
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in out) == texts
    assert all(r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None for r in out)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op6_and_op8(spark, folder):
    path, rows = folder
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: library.encode(text or "", add_special_tokens=False).ids
    made, at = Q.op6_token_files(spark, path).orderBy("start").collect(), 0
    assert [r.doc_id for r in made] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    for r in made:
        assert r.start == at
        at += r.n_tokens
    crc = lambda text: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*ids(text), 0]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in made) == Counter((i, len(ids(t)) + 1, crc(t)) for i, t, _, _ in rows)
    counted = Q.op8_token_counts(spark, path).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in counted) == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t, _, _ in rows)


def test_op7(spark, folder):
    path, rows = folder
    fps = [plain_fingerprint(t, 4) for _, t, _, _ in rows]
    groups = plain_groups(fps, 4)
    least = {g: min(i for (i, *_), h in zip(rows, groups, strict=True) if h == g and i is not None) for g in set(groups) if any(h == g and r[0] is not None for r, h in zip(rows, groups, strict=True))}
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in Q.op7_simhash(spark, path).collect())
    assert got == Counter((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fps, groups, strict=True))


def test_op9(spark, folder):
    against_sql(spark, folder[0], "op9_decontaminate")
    hit = {r.doc_id: r for r in Q.op9_decontaminate(spark, folder[0]).collect() if r.contaminated}
    assert set(hit) >= {500, 501} and hit[501].items_sha256 == hashlib.sha256(b"a,b,b,c").hexdigest()
