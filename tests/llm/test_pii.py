"""Base spans against the contract's expressions in a plain loop; learned spans against a plain version of the bootstrap."""

import hashlib
import random
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm import queries as Q

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def good(kind, m):
    digits = [c for c in m if c in "0123456789"]
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain_base(text):
    forms = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return [(kind, m.start(), m.end()) for kind, form in forms.items() for m in regex.finditer(form, text or "") if good(kind, m.group())]


def seed_kind(unit):
    forms = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return next((k for k, form in forms.items() if regex.fullmatch(form, unit) and good(k, unit)), None)


def units(text):
    found = [(m.group(), m.start(), m.end()) for m in regex.finditer(pii.UNIT, text or "")]
    low = ["", "", "", *[u.lower() for u, _, _ in found], ""]
    for k, (u, a, b) in enumerate(found):
        l3, l2, l1, r1 = low[k], low[k + 1], low[k + 2], low[k + 4]
        yield u, a, b, [("l1", l1), ("l2", l2, l1), ("l3", l3, l2, l1), ("lr", l1, r1)]


def plain_spans(texts):
    """The spans of distinct texts, from the definition."""
    told, kinds, words, spots = defaultdict(set), {}, defaultdict(set), defaultdict(set)
    for text in texts:
        for u, _, _, contexts in units(text):
            v = u.lower()
            if regex.search(pii.CANDIDATE, u):
                kinds[v] = seed_kind(u)
                spots[v].add(tuple(contexts))
                for h in contexts:
                    told[h].add(v)
            else:
                for h in contexts:
                    words[h].add(v)
    own = {v: float(k is not None) for v, k in kinds.items()}
    known = {h: v for h, v in told.items() if len(v) >= pii.SUPPORT and any(kinds[x] for x in v)}
    for turn in range(pii.ROUNDS + 1):
        mass = {h: sum(own[x] for x in v) for h, v in known.items()}
        score = {h: round(mass[h] / (len(v) + len(words[h])), 9) for h, v in known.items()}
        if turn < pii.ROUNDS:
            use = {h: s for h, s in score.items() if mass[h] >= pii.SUPPORT and s >= pii.LEAST}
            own = {v: 1.0 if kinds[v] else sum(max(use.get(h, 0) for h in c) for c in spots[v]) / len(spots[v]) for v in kinds}
    good_ = {h: s for h, s in score.items() if mass[h] >= pii.SUPPORT and s >= pii.ACCEPT}
    most = {h: max(pii.KINDS, key=lambda k: (sum(kinds[x] == k for x in known[h]), -pii.KINDS.index(k))) for h in good_}
    out = {}
    for text in texts:
        spans = plain_base(text)
        base = list(spans)
        for u, a, b, contexts in units(text):
            fit = [h for h in contexts if h in good_]
            if regex.search(pii.CANDIDATE, u) and not seed_kind(u) and fit and not any(x[1] < b and x[2] > a for x in base):
                best = max(fit, key=lambda h: (good_[h], -pii.KINDS.index(most[h])))
                spans.append((most[best], a, b))
        out[text] = sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))
    return out


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark):
    rnd = random.Random(2)
    bits = ["a@b.c", "_d@e.f", "x.", ".", "@", "+1", "(", ") ", "555", "-", " ", "4111111111111111", "4111 1111-1111 1111", "255.255.1.0", "256.1.1.1", "001.2.3.4", "é😀", "9", "0", "%", "\n", "+44 20 7946 0958", "a", "é"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(3000)] + [None, "", "1 " * 40_000, "a." * 40_000, "." * 40_000, "+1" + " " * 40_000, "a@" * 20_000, "1.2.3.4 " * 700 + "a@b.cd " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = {r.k: r.s for r in rows.select("k", pii.listed(pii.base_spans(F.col("text"))).alias("s")).collect()}
    for k, text in enumerate(texts):
        assert out[k] == written(plain_base(text)), (text or "")[:100]


def corpus():
    rnd, words = random.Random(6), [w + e for w in ("ba", "do", "ki", "lu", "me") for e in ("", "n", "ra", "sto", "ti")]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    phone = lambda: f"+1 ({rnd.randint(200, 989)}) 555-{rnd.randint(1000, 9999)}"
    texts = [f"{said(20)} {rnd.choice(['Reach her at', 'direct line:'])} {phone()} {said(9)}" for _ in range(30)]
    texts += [f"{said(8)}. Write to {said(1)}{k}@mail.example.org, {said(6)}" for k in range(12)] + [f"{said(9)} write to {w}" for w in ("nobody", "them", "us")]
    texts += [f"{said(9)} reach her at 555-{k}12 {said(4)}" for k in range(5)] + [f"{said(9)} direct line: ext_{k}77" for k in range(4)] + [f"{said(5)} write to kim[at]mail.example {said(3)}"]
    texts += [f"{said(12)} in {1900 + k} {said(4)}" for k in range(40)] + [f"{said(3)} {phone()} {said(3)}" for _ in range(20)]
    return texts + [texts[0]] * 40 + [None, "", "😀 reach her at 555-00 and direct line: x_1", "1 2 3 " * 3000]


def test_learned_spans(spark, docs, stored):
    texts = corpus()
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[31]), (3, texts[3]), (3, "direct line: q_9")]
    clash = docs(rows)
    for name in ("found", "spans", "ord", "v", "h", "score", "_id", "_key", "x", "_base"):
        clash = clash.withColumn(name, F.lit("c"))
    folder = stored(documents=clash.repartition(3))
    want = plain_spans({t for _, t in rows})
    expected = Counter()
    for k, t in rows:
        base = plain_base(t)
        n = Counter(x[0] for x in base)
        expected[(k, *[n[kind] for kind in pii.KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(want[t]))] += 1
    got = Counter(tuple(r) for r in Q.op11_personal_data(spark, folder).collect())
    assert got == expected
    found = {t: [t[a:b] for _, a, b in v] for t, v in want.items() if t}
    added = {x for t, v in found.items() for x in v} - {t[a:b] for t in found for _, a, b in plain_base(t)}
    assert added >= {"555-012", "ext_077", "kim[at]mail.example", "555-00", "x_1", "q_9"} and not any(x.startswith("19") for x in added)
    whole = pii.personal_data(spark.read.parquet(f"{folder}/documents.parquet"))
    assert {"_id", "_key", "v"} <= set(whole.columns)
    shown = {r.text: r.m for r in whole.select("text", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert shown["😀 reach her at 555-00 and direct line: x_1"] == "😀 reach her at <phone> and direct line: <phone>"
    assert shown[None] is None and shown[""] == ""


def test_nothing_to_learn(spark, docs, stored):
    assert not Q.op11_personal_data(spark, stored(documents=docs([]))).collect()


def test_meeting_spans_are_masked_whole(spark):
    df = spark.sql("SELECT 'ab12345cd' AS text, array(named_struct('kind', 2, 'start', 2L, 'end', 5L), named_struct('kind', 3, 'start', 4L, 'end', 7L)) AS spans")
    assert df.select(pii.masked(F.col("text"), F.col("spans"))).first()[0] == "ab<card>cd"
