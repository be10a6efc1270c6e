import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_counts, token_files
from tidemark.llm.bpe import Pieces, pieces_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello  world\n\n it's 'rest we're", "<|endoftext|>ab<|endoftext|>", "naïve café — 12,345€ …", "日本語 text 한국어", "emoji 😀  nbsp\x1c", "x" * 3000, " \t\n  ", "!!<|endoftext|>", "a" + " " * 50 + "b"]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (3, "again"), (3, "again"), (None, "no id")]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_agree_with_the_library(library):
    p = Pieces(PATH)
    for text in TEXTS:
        assert np.frombuffer(p.encode(text), p.width).tolist() == library(text)
        assert p.count(text) == len(library(text))
    for text in TEXTS:
        text = text[:300]
        assert p.table_of(text).tolist() == [len(library(text[:k])) for k in range(len(text) + 1)]


ODD = ["ёлка и Ёж", "مرحبا بالعالم", "soft\u00adhyphen\u00ad s", "नमस्ते  दुनिया", "ไทย 😀😀\u200d🔥 x", "a\u0301 e\u0301\u0302", "\xa0\xa0b \u3000 c\x1c d", "'re'ré 😀's ²½ ⅷ", "😀 <|endoftext|>\u2003\n\n é"]


@pytest.mark.parametrize("text", ODD)
def test_odd_characters_go_through_the_same_program(library, text):
    p = Pieces(PATH)
    assert "".join(piece for some in p.pieces(text) for piece in some) == text
    assert p.table_of(text).tolist() == [len(library(text[:k])) for k in range(len(text) + 1)]
    assert p.count(text) == len(library(text)) and np.frombuffer(p.encode(text), p.width).tolist() == library(text)


def test_long_text_of_odd_characters(library, monkeypatch):
    text = "".join(ODD[k % len(ODD)] + " word\n"[k % 2 :] for k in range(20_000)) + "😀" * 1000
    p = Pieces(PATH)
    want = library(text)
    assert p.count(text) == len(want) == p.table_of(text)[-1] and np.frombuffer(p.encode(text), p.width).tolist() == want
    monkeypatch.setattr("tidemark.llm.bpe.LENGTH", 40)
    assert Pieces(PATH).count(text) == len(want)


def test_counts(spark, docs, library):
    out = token_counts.count_tokens(docs(ROWS).select("doc_id", "text"), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len(library(t))) for i, t in ROWS)


def test_prefix_tables_answer_budgets(spark, docs, library):
    df = token_counts.prefix_tables(docs([(1, TEXTS[1]), (2, None)]), PATH)
    row = df.select(token_counts.fitting_prefix(F.col("prefix_tokens"), F.lit(5)).alias("p"), token_counts.tokens_before(F.col("prefix_tokens"), F.lit(7)).alias("n"), "doc_id").orderBy("doc_id").collect()
    best = max(k for k in range(len(TEXTS[1]) + 1) if len(library(TEXTS[1][:k])) <= 5)
    assert (row[0].p, row[0].n) == (best, len(library(TEXTS[1][:7])))
    assert (row[1].p, row[1].n) == (0, 0)


def test_sentencepiece_counts(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts.count_tokens(docs([(1, "Hello world"), (2, None)]), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [len(model.encode("Hello world")), 0]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    form = token_files.Format(block=64, bits=bits)
    for n in (0, 1, 63, 64, 65, 1000):
        for kind in ("<u2", "<u4"):
            ids = (np.arange(n) * 7919 % 50000).astype(kind)
            sizes, body = token_files.to_planes(ids, form)
            assert token_files.from_planes(sizes, body, n, ids.itemsize, form).tolist() == ids.tolist()


@pytest.mark.parametrize("form", [token_files.Format(), token_files.Format(block=32, chunk=100, bits=True)])
def test_token_set(spark, docs, library, tmp_path, form):
    path = str(tmp_path / "set")
    token_files.write_tokens(docs(ROWS), path, PATH, form=form, parts=3)
    out = token_files.read_tokens(spark, path).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text) in zip(out, order, strict=True):
        ids = [*library(text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_token_set(spark, docs, tmp_path):
    token_files.write_tokens(docs([]), str(tmp_path / "set"), PATH)
    assert token_files.read_tokens(spark, str(tmp_path / "set")).count() == 0


def test_one_reader_for_each_file():
    assert pieces_of(PATH) is pieces_of(PATH)
