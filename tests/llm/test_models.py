import random

from tidemark.llm import language_id, toxicity

VOCABULARY = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["jeg", "hedder", "ikke", "hvad"], "cc": ["привет", "мир", "это", "слово"]}


def texts(lang, n, rnd):
    return [" ".join(rnd.choice(VOCABULARY[lang]) for _ in range(rnd.randint(3, 30))) for _ in range(n)]


def test_language_held_out(spark, docs):
    rnd = random.Random(1)
    rows = [(k, t, lang) for lang in VOCABULARY for k, t in enumerate(texts(lang, 40, rnd))]
    model = language_id.train(docs(rows + [(1, None, "aa"), (2, "zzz", None), (3, "", "aa")]))
    test = [(k, t, lang) for lang in VOCABULARY for k, t in enumerate(texts(lang, 20, rnd))] + [(900, None, "und"), (901, "", "und"), (902, "123 !?", "und"), (903, "LOREM " * 200_000, "aa")]
    out = language_id.identify(docs(test), model).collect()
    assert all(r.lang_pred == r.lang for r in out) and all(0 <= r.score <= 1 for r in out)
    assert language_id.identify(docs([(1, "qqq")]), model).first().score == 0


def test_parts_of_a_text_have_its_ngrams(monkeypatch):
    import numpy as np

    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aß Ж.é1中\U00010400") for _ in range(n)) for n in (0, 1, 2, 5, 40, 300)]

    def all_of():
        found = [[] for _ in texts]
        for codes, owner in language_id.grams(texts):
            for c, k in zip(codes.tolist(), owner.tolist(), strict=True):
                found[k].append(c)
        return [sorted(x) for x in found]

    whole = all_of()
    for size in (3, 7, 50):
        monkeypatch.setattr(language_id, "PIECE", size)
        assert all_of() == whole
    assert [len(x) for x in whole][:2] == [0, len(whole[1])] and np.all([len(x) for x in whole[3:]])


def test_language_without_labels(spark, docs):
    model = language_id.train(docs([(1, "a", None)]))
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs([(1, "abc"), (2, None)]), model).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(docs([]), model).count() == 0


def test_false_positives_are_corrected():
    import numpy as np

    f = language_id.Filter(["a", "b"], "a", np.zeros((2, 1), np.uint64), np.array([0.0, 0.5]), 1)
    names, _ = f.decide(np.array([10.0, 10.0]), np.array([[2.0, 5.0], [2.0, 9.0]]))
    assert names.tolist() == ["a", "b"]


def toxic_rows(n, rnd, first):
    rows = []
    for k in range(n):
        words = [rnd.choice("river stone light garden walk slow green morning".split()) for _ in range(rnd.randint(20, 80))]
        bad = k % 3 == 0
        for _ in range(4 * bad):
            words.insert(rnd.randrange(len(words)), "grumbo" + rnd.choice("abcdefgh"))
        rows.append((first + k, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rnd = random.Random(2)
    made = lambda n, first: spark.createDataFrame(toxic_rows(n, rnd, first), "doc_id long, text string, toxic int")
    model = toxicity.train(made(300, 0), made(150, 1000))
    out = toxicity.score_documents(made(120, 5000), model).collect()
    assert sum(r.predicted == r.toxic for r in out) >= 118
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123"), (4, "river " * 300_000)], "doc_id long, text string")
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in toxicity.score_documents(odd, model).collect())
    assert toxicity.score_documents(odd.limit(0), model).count() == 0


def test_toxicity_without_both_classes(spark):
    one = spark.createDataFrame([(1, "a b", 0), (2, None, 1), (3, "c", None)], "doc_id long, text string, toxic int")
    model = toxicity.train(one, one)
    assert [r.score for r in toxicity.score_documents(one, model).collect()] == [0.0] * 3


def test_curve_of_nothing():
    import numpy as np

    assert toxicity.fit_curve(np.zeros(0), np.zeros(0)) == (1.0, -1.0)
