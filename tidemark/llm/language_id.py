"""Language identification with language-bitmask n-gram filters.

Training counts every character n-gram of the labelled documents by language. An n-gram belongs to the languages in
which it is common: at least ``SHARE`` of its highest relative frequency in any language. The filter is a bit-sliced
Bloom filter: a fixed number of slots, each a bitmask with one bit for each language; an n-gram sets its languages'
bits in ``HASHES`` slots, and the conjunction of those slots names all languages that contain it at once. For a
document the bits of its n-grams are counted by language, the counts are corrected by each language's rate of false
positives (its share of set bits to the power of ``HASHES``), and the language with the highest corrected count wins;
ties go to the first in code-point order.

Texts are taken whole: lower-cased, with runs of anything but letters as one space, and with a space at either end.
Long texts pass in parts of ``PIECE`` characters that begin with the last letters of the part before, so their n-grams
are those of the whole text. N-grams seen fewer than ``LEAST`` times in all teach nothing.

Defined results: ``und`` with score 0 for texts that are null or have no letter, and for all if nothing was learned;
a text none of whose n-grams is known gets the commonest language, with score 0; rows with a null or empty language
teach nothing; repeated rows count as often as they occur; an empty table gives no rows. The model's size is fixed by
``slots`` and the number of languages, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

SIZES = (2, 3)
SLOT_BITS, HASHES, SHARE, LEAST = 20, 3, 0.3, 2
PIECE = 400_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str) -> Iterator[np.ndarray]:
    """The code points of a text's letters and blanks, in parts."""
    lowered, blank = f" {text.lower()} ", False
    for at in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_is_letter()[points], points, 32)
        space = points == 32
        keep = ~(space & np.concatenate([[blank], space[:-1]]))
        blank = bool(space[-1])
        yield points[keep].astype(np.uint64)


def _codes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size: 64-bit codes of all n-grams of the points."""
    code = points
    for n in range(2, max(SIZES) + 1):
        if n == 2:
            code = points[:-1] * np.uint64(1 << 21) + points[1:]
        else:
            code = _mixed(code[: max(0, len(points) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :])
        if n in SIZES:
            yield n, code


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit codes of all n-grams of the texts, some at a time, and the number of the text each is from."""
    held, owners, size = [], [], 0

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        points, owner = np.concatenate(held), np.concatenate(owners)
        for n, code in _codes(points):
            within = owner[: len(code)] == owner[n - 1 :]
            yield code[within], owner[: len(code)][within]

    for k, text in enumerate(texts):
        tail = np.zeros(0, np.uint64)
        for points in normalised(text):
            if not len(tail) and len(text) + 2 <= PIECE:  # a whole text: several are taken at a time
                held.append(points)
                owners.append(np.full(len(points), k, np.int32))
                size += len(points)
                if size > PIECE:
                    yield from cut()
                    held, owners, size = [], [], 0
                continue
            joined = np.concatenate([tail, points])
            for n, code in _codes(joined):
                new = code[max(0, len(tail) - n + 1) :]
                yield new, np.full(len(new), k, np.int32)
            tail = joined[max(0, len(joined) - max(SIZES) + 1) :]
    if held:
        yield from cut()


def slots_of(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The HASHES slots of each code, by double hashing."""
    first = _mixed(codes + np.uint64(0x632BE59BD9B4E019))
    step = (first >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filter:
    languages: list[str]
    common: str  # the commonest language
    masks: np.ndarray  # slots x words of 64 languages
    wrong: np.ndarray  # rate of false positives by language
    bits: int

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text: n-grams in all, and hits by language."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for codes, owner in grams(texts):
            first, *rest = slots_of(codes, self.bits)
            found = self.masks[first]
            for more in rest:
                found &= self.masks[more]
            total += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.languages)):
                bit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] += np.bincount(owner, weights=bit, minlength=len(texts))
        return total, hits

    def decide(self, total: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        true = np.maximum(0, (hits - total[:, None] * self.wrong) / np.maximum(1e-9, 1 - self.wrong))
        best, every = true.argmax(1), true.sum(1)
        score = np.divide(true.max(1), every, out=np.zeros(len(true)), where=every > 0)
        names = np.where(every > 0, np.array(self.languages, object)[best], self.common)
        return names, score


def count_grams(labelled: DataFrame) -> DataFrame:
    """(code, lang, n) of all n-grams of (text, lang) rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def packed(lang: str) -> pd.DataFrame:
            codes, n = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            unique, back = np.unique(codes, return_inverse=True)
            size[lang] = 0
            return pd.DataFrame({"code": unique.view(np.int64), "lang": lang, "n": np.bincount(back, weights=n).astype(np.int64)})

        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for codes, _ in grams(list(rows["text"])):
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
                    if size[lang] > 2_000_000:
                        yield packed(lang)
        for lang in list(held):
            yield packed(lang)

    rows = labelled.select("text", "lang").mapInPandas(counted, "code long, lang string, n long")
    return rows.groupBy("code", "lang").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, bits: int = SLOT_BITS) -> Filter:
    """Learns from (text, lang) rows; the driver gets the languages and at most ``2 ** bits`` slots."""
    labelled = labelled.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    seen = labelled.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return Filter([], "und", np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    words = -(-len(languages) // 64)
    counts = settled(count_grams(labelled))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    place = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])
    top = rate.groupBy("code").agg(F.max("rate").alias("top"), F.sum("n").alias("all")).where(F.col("all") >= LEAST)
    marked = rate.join(top, "code").where(F.col("rate") >= SHARE * F.col("top")).select("code", place[F.col("lang")].alias("k"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            k = rows["k"].to_numpy(np.int64)
            bit = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            for slots in slots_of(rows["code"].to_numpy(np.int64).view(np.uint64), bits):
                yield pd.DataFrame({"slot": slots, "word": k // 64, "mask": bit})

    slots = marked.mapInPandas(spread, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((1 << bits, words), np.uint64)
    masks[slots["slot"].to_numpy(np.int64), slots["word"].to_numpy(np.int64)] = slots["mask"].to_numpy(np.int64).view(np.uint64)
    filled = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    common = min(seen, key=lambda r: (-r["count"], r["lang"]))["lang"]
    return Filter(languages, common, masks, filled**HASHES, bits)


def identify(documents: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            texts = list(texts)
            lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
            if model.languages:
                names, score = model.decide(*model.counts([t or "" for t in texts]))
            else:
                names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            yield pd.DataFrame({"lang_pred": np.where(lettered, names, "und"), "score": np.where(lettered, score, 0.0)})

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]
    return documents.select(*kept, predicted(F.col(text)).alias("lang_pred")).select(*kept, "lang_pred.*")
