"""Toxicity by two class-conditional Kneser-Ney models.

Both models spell words: each letter of a word, and its end, follows from the ``ORDER`` letters before it, the word's start
included. Counts are of documents: a word counts once in each labelled document of a class that holds it. As in
Kneser-Ney smoothing every count is discounted and the rest of the mass backs off. Both classes back off to one
distribution, that of their pooled counts after the same letters, which also gets ``SHARED`` counts of its own in each class:
rare expressions cannot tell the classes apart, common ones only as far as the classes' counts do, and words of a single
labelled document teach nothing.

Each word of a document is one event; its evidence is the difference of the two log-likelihoods of its letters. A run of
more than ``PIECE`` letters (scripts without blanks) is as many events as it has pieces, each with the letters before it
as context; all letters are read. A document's evidence is the mean over the ``TOP`` share of its events that speak most
for the toxic model, so it depends neither on the text's length nor on its language. A logistic curve, fitted on
labelled documents that gave no counts, turns it into a score.

The counts cover every labelled document. A step of an evidence below ``LEAST`` counts as none, whatever the corpus's size.
Tasks get the telling steps as a table while these are ``SENT_STEPS`` or fewer; beyond that, words meet the steps, and documents
their words, in joins, with the same results.

Texts are taken whole, lower-cased; words are runs of letters.

Defined results: a text that is null or has no letter has no evidence and gets the curve's value there (never over
the share of toxic documents); without labelled documents of both classes every score is 0; labels that are null, or
neither 0 nor 1, teach nothing, and a document with several labels teaches each of them; repeated rows each give a
row; an empty table gives no rows. Columns named ``score`` and ``predicted`` are replaced, others passed on.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT_ROWS, perhaps_in, settled

#: Letters before a letter that it follows from, discount, and counts that each class shares with the other.
ORDER, DISCOUNT, SHARED = 9, 0.75, 100.0
#: Labelled documents that a word has to be in to teach anything.
LEAST_DOCUMENTS = 2
#: Share of a document's events that decide, least evidence of a step that counts, letters of an event at most.
TOP, LEAST, PIECE = 0.02, 0.1, 40
#: Steps that are sent to tasks at most (some 13 bytes each, about 100 MB for a worker); more are joined.
SENT_STEPS = 8_000_000
#: Documents that the curve is fitted on at most, and the share of labelled documents if that is less.
CURVE_ROWS, CURVE_SHARE, STEPS = 20_000, 0.25, 25
#: Words kept for each worker.
KEPT = 150_000
WORD = re.compile(r"[^\W\d_]+")
START, END, GOES_ON = "\x02", "\x03", "\x04"


def events(text: str) -> list[str]:
    """The words of a text between their marks; long ones in pieces that begin with a mark and the letters before them."""
    out = []
    for run in WORD.findall(text.lower()):
        whole = START + run + END
        if len(run) <= PIECE:
            out.append(whole)
            continue
        out.append(whole[: PIECE + 1])
        out += [GOES_ON + whole[k - ORDER : k + PIECE] for k in range(PIECE + 1, len(whole), PIECE)]
    return out


def grams(event: str) -> list[str]:
    """Each letter of an event with those that it follows from."""
    letters, first = (event, 1) if event[0] == START else (event[1:], ORDER)
    return [letters[max(0, k - ORDER) : k + 1] for k in range(first, len(letters))]


def _grams(event: Column) -> Column:
    """``grams`` as a column."""
    whole = F.startswith(event, F.lit(START))
    letters = F.when(whole, event).otherwise(F.expr("substring(word, 2)"))
    at = F.sequence(F.when(whole, F.lit(1)).otherwise(F.lit(ORDER)), F.length(letters) - 1)
    return F.transform(at, lambda k: F.substring(letters, F.greatest(k - ORDER, F.lit(0)) + 1, F.least(k, F.lit(ORDER)) + 1))


def labelled(documents: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents and labels of one id; (toxic, packed) if the labels, (doc_id, toxic), are too many to be sent.

    Then the labels meet the packed distinct events of the documents that can have one: texts are not shuffled.
    """
    told = told.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    if told.count() <= SENT_ROWS:
        return documents.select("doc_id", "text").join(F.broadcast(told), "doc_id")
    held = told.withColumnRenamed("doc_id", "_lb_id")
    near = perhaps_in(documents.select("doc_id", "text"), held, {"doc_id": "_lb_id"}, "_lb_may").where("_lb_may and text is not null")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress("\n".join(dict.fromkeys(events(t))).encode("utf-8", "surrogatepass"), 1) for t in texts])

    return near.select(F.col("doc_id").alias("_lb_doc"), packed("text").alias("packed")).join(held, F.col("_lb_doc") == F.col("_lb_id")).select("toxic", "packed")


def _unpacked(packed: bytes) -> list[str]:
    return [x for x in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if x]


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, t, o): toxic and ordinary documents that hold each word; of (toxic, text) or (toxic, packed) rows."""
    held_as, held_in = ("packed", _unpacked) if "packed" in labelled.columns else ("text", events)

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def packed(kind: int) -> pd.DataFrame:
            n = np.fromiter(held[kind].values(), np.int64, len(held[kind]))
            out = pd.DataFrame({"word": list(held[kind]), "t": n * kind, "o": n * (1 - kind)})
            held[kind].clear()
            return out

        for batch in batches:
            for x, kind in zip(batch[held_as], batch["toxic"], strict=True):
                held[kind].update(set(held_in(x)))
                if len(held[kind]) > 2 * KEPT:
                    yield packed(kind)
        for kind in held:
            if held[kind]:
                yield packed(kind)

    rows = labelled.select(held_as, "toxic").mapInPandas(words_of, "word string, t long, o long")
    return rows.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _unseen(t: str, n: str) -> Column:
    """A class's mass beyond its discounted counts, over all: shared counts and what the discount took."""
    return (DISCOUNT * F.col(t) + SHARED) / (F.col(n) + SHARED)


def spelling_steps(words: DataFrame) -> DataFrame:
    """(step, known, unknown): a letter's evidence after those before it, and that of a letter never met after these. Telling ones only."""
    steps = words.where(F.col("t") + F.col("o") >= LEAST_DOCUMENTS).select(F.explode(_grams(F.col("word"))).alias("step"), "t", "o")
    steps = settled(steps.groupBy("step").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))).withColumn("after", F.expr("substring(step, 1, length(step) - 1)"))
    some = lambda c: F.count(F.when(F.col(c) > 0, 1))
    after = steps.groupBy(F.col("after").alias("step")).agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), some("t").alias("kt"), some("o").alias("ko"), F.count("*").alias("k"))
    after = after.withColumn("unknown", F.log(_unseen("kt", "nt")) - F.log(_unseen("ko", "no")))
    letters = steps.agg(F.countDistinct(F.substring("step", -1, 1)).alias("letters"))
    drawn = steps.join(after.withColumnRenamed("step", "after"), "after").join(F.broadcast(letters))
    n, c = F.col("nt") + F.col("no"), F.col("t") + F.col("o")
    pooled = (F.greatest(c - DISCOUNT, F.lit(0)) + DISCOUNT * F.col("k") / F.col("letters")) / n

    def given(count: str, kinds: str, total: str) -> Column:
        return F.greatest(F.col(count) - DISCOUNT, F.lit(0)) / (F.col(total) + SHARED) + _unseen(kinds, total) * pooled

    known = drawn.select("step", (F.log(given("t", "kt", "nt")) - F.log(given("o", "ko", "no"))).alias("known"), F.col("unknown").alias("else"))
    met = known.join(after.select("step", "unknown"), "step", "full_outer")
    telling = F.greatest(*[F.abs(F.coalesce(c, F.lit(0.0))) for c in ("known", "unknown", "else")]) >= LEAST
    cut = lambda c: F.when(F.abs(c) >= LEAST, F.col(c)).otherwise(0.0).alias(c)
    return met.where(telling).select("step", cut("known"), cut("unknown"), F.col("known").isNotNull().alias("seen"))


#: Events hashed at a time, and the base of the polynomial in 64 bits.
CHUNK, BASE = 20_000, np.uint64(0x9E3779B97F4A7C15)


def _prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of every beginning of each word (column k: of its first k letters), and the words' lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    laid = np.zeros((len(words), int(sizes.max(initial=0))), np.uint64)
    laid[np.arange(laid.shape[1]) < sizes[:, None]] = letters
    out = np.zeros((len(words), laid.shape[1] + 1), np.uint64)
    for k in range(laid.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + laid[:, k]
    return out, sizes


def hashed(words: list[str]) -> np.ndarray:
    """One hash for each word; the arithmetic wraps at 64 bits."""
    parts = [np.zeros(0, np.uint64)]
    for k in range(0, len(words), CHUNK):
        upto, sizes = _prefixes(words[k : k + CHUNK])
        parts.append(upto[np.arange(len(sizes)), sizes])
    return np.concatenate(parts)


@dataclass
class Table:
    """Hashes, ascending, and their values; all others have zeros."""

    keys: np.ndarray
    values: np.ndarray

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[place] == keys
        return there, np.where(there, self.values[place], np.float32(0))


@dataclass
class Steps:
    """Steps as tables for the tasks: evidence of the letters met after others, and of letters never met after some."""

    known: Table
    unknown: Table


def _table(steps: DataFrame) -> Steps:
    """At most ``SENT_STEPS`` rows, for the tasks. Steps are hashed where they are, so numbers alone come to the driver."""

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": hashed(batch["step"].tolist()).view(np.int64), **{c: batch[c].astype(np.float32) for c in ("known", "unknown")}, "seen": batch["seen"]})

    found = steps.select("step", "known", "unknown", "seen").mapInPandas(numbers, "key long, known float, unknown float, seen boolean").toArrow()
    keys, seen = found["key"].to_numpy().view(np.uint64), found["seen"].to_numpy()

    def part(which: np.ndarray, value: str) -> Table:
        some = np.flatnonzero(which)
        some = some[np.argsort(keys[some])]
        return Table(keys[some], found[value].to_numpy()[some])

    return Steps(part(seen, "known"), part(found["unknown"].to_numpy() != 0, "unknown"))


def sent_if_few(steps: DataFrame) -> Steps | DataFrame:
    """The steps as tables for the tasks, or as they are if there are too many."""
    return _table(steps) if steps.count() <= SENT_STEPS else steps


_known: dict[str, dict[str, float]] = {}


@dataclass
class Model:
    steps: Steps | DataFrame  # evidence of a letter after others, and of one never met after these; or too many for tables
    slope: float = 1.0
    offset: float = 0.0
    empty: bool = False
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    sent: Broadcast | None = None

    def in_tasks(self, spark: SparkSession) -> Callable[[], Model]:
        """Gives the model inside tasks; its tables are sent once, however often it is asked for."""
        sent = self.sent = self.sent or spark.sparkContext.broadcast(self.steps)
        rest = (self.slope, self.offset, self.empty, self.name)
        return lambda: Model(sent.value, *rest)

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each event's letters: of the step if it was seen, else of what may follow its letters."""
        return np.concatenate([np.zeros(0), *[self._evidence(words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)]])

    def _evidence(self, words: list[str]) -> np.ndarray:
        first = np.fromiter((1 if w[0] == START else ORDER for w in words), np.int64, len(words))
        upto, sizes = _prefixes([w if w[0] == START else w[1:] for w in words])
        out, k = np.zeros(len(words)), np.arange(1, upto.shape[1] - 1)
        begun = np.maximum(k - ORDER, 0)  # where the letters before letter k begin
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(ORDER + 1, BASE)]), dtype=np.uint64)
        before = upto[:, k] - upto[:, begun] * power[k - begun]
        own = upto[:, k + 1] - upto[:, begun] * power[k - begun + 1]
        row, col = np.nonzero((k >= first[:, None]) & (k < sizes[:, None]))
        seen, value = self.steps.known.at(own[row, col])
        np.add.at(out, row[seen], value[seen])
        row, col = row[~seen], col[~seen]
        np.add.at(out, row, self.steps.unknown.at(before[row, col])[1])
        return out

    def known(self, words: set[str]) -> dict[str, float]:
        """Evidence of the words, kept for this worker."""
        if self.name not in _known:
            _known.clear()  # one model at a time
            _known[self.name] = {}
        known = _known[self.name]
        if new := [w for w in words if w not in known]:
            if len(known) + len(new) > KEPT:
                known.clear()
                new = list(words)
            known.update(zip(new, self.word_evidence(new).tolist(), strict=True))
        return known

    def evidence(self, texts: list) -> np.ndarray:
        """The mean evidence of each text's most toxic events, 0 without words."""
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            words = events(text) if text else []
            if not words:
                continue
            known = self.known(set(words))
            each = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            top = max(1, int(len(each) * TOP))
            out[k] = np.partition(each, len(each) - top)[len(each) - top :].mean()
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return np.zeros(len(evidence)) if self.empty else 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -500, 500)))


def _usable(labelled: DataFrame) -> DataFrame:
    """Without rows that teach nothing; packed rows have none."""
    return labelled if "packed" in labelled.columns else labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1))


def train(counting: DataFrame, fitting: DataFrame) -> Model:
    """Learns counts from ``counting`` and the curve from ``fitting``, rows without a document in common: (doc_id, text, toxic), or as ``labelled`` gives them to be counted."""
    counted = settled(count_words(_usable(counting)))
    classes = counted.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).first()
    if not classes["t"] or not classes["o"]:
        none = Table(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return Model(Steps(none, none), empty=True)
    steps = settled(spelling_steps(counted))
    model = Model(sent_if_few(steps))
    sample = _usable(fitting).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)
    fitted = evidence_of(sample, model).select("evidence", F.col("toxic").cast("double")).toPandas()
    model.slope, model.offset = fit_curve(fitted["evidence"].to_numpy(), fitted["toxic"].to_numpy())
    return model


def curve_part(doc_id: Column, labelled_rows: int) -> Column:
    """Which labelled documents the curve is fitted on, by a hash of the id: at most about ``CURVE_ROWS`` of them."""
    share = min(CURVE_SHARE, CURVE_ROWS / max(1, labelled_rows))
    return F.pmod(F.xxhash64(F.lit("curve"), doc_id), F.lit(1 << 20)) < math.ceil(share * (1 << 20))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, slightly regularised; the slope is never negative."""
    if not len(x):
        return 1.0, -1.0
    scale = max(float(np.std(x)), 1e-9)
    rows = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (y - p) - 1e-3 * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, slope), -4, 4)
    return max(0.0, float(w[0] / scale)), float(w[1])


def evidence_of(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``evidence``."""
    if isinstance(model.steps, DataFrame):
        return _joined_evidence(documents, model.steps, text)
    there = model.in_tasks(documents.sparkSession)

    @F.pandas_udf("double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = there()
        for texts in batches:
            yield pd.Series(model.evidence(list(texts)))

    return documents.withColumn("evidence", measured(F.col(text)))


def _counted_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a, b, text in zip(batch["a"], batch["b"], batch["text"], strict=True):
            held = Counter(events(text))
            if held:
                yield pd.DataFrame({"a": a, "b": b, "word": list(held), "n": list(held.values())})


def _joined_evidence(documents: DataFrame, steps: DataFrame, text: str) -> DataFrame:
    """``evidence_of`` for any number of steps: distinct events meet the steps once, distinct texts their events."""
    key = [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b")]
    held = documents.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text")).dropDuplicates(["a", "b"]).mapInPandas(_counted_events, "a long, b long, word string, n long")
    held = settled(held)
    each = held.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("step")).withColumn("before", F.expr("substring(step, 1, length(step) - 1)"))
    own = each.join(steps.where("seen").select("step", "known", "seen"), "step", "left")
    both = own.join(steps.where("unknown != 0").select(F.col("step").alias("before"), "unknown"), "before", "left")
    said = both.groupBy("word").agg(F.sum(F.when(F.col("seen"), F.col("known")).otherwise(F.coalesce("unknown", F.lit(0.0)))).alias("e"))
    pairs = held.join(said, "word").groupBy("a", "b").agg(F.sum("n").alias("events"), F.sort_array(F.collect_list(F.struct("e", "n")), asc=False).alias("best"))
    top = F.greatest(F.floor(F.col("events") * TOP), F.lit(1)).cast("long")
    start = F.struct(F.lit(0.0).alias("sum"), top.alias("left"))
    taken = F.aggregate("best", start, lambda s, x: F.struct((s["sum"] + x["e"] * F.least(s["left"], x["n"])).alias("sum"), (s["left"] - F.least(s["left"], x["n"])).alias("left")))
    found = settled(pairs.select(F.col("a").alias("_tx_a"), F.col("b").alias("_tx_b"), (taken["sum"] / top).alias("_tx_e")))
    whole = documents.select(F.struct(*documents.columns).alias("_tx_row"), *[k.alias(f"_tx_{n}k") for k, n in zip(key, "ab", strict=True)])
    met = whole.join(found, (F.col("_tx_ak") == F.col("_tx_a")) & (F.col("_tx_bk") == F.col("_tx_b")), "left")
    return met.select("_tx_row", F.coalesce("_tx_e", F.lit(0.0)).alias("_tx_e")).select("_tx_row.*", F.col("_tx_e").alias("evidence"))


def score_documents(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    if isinstance(model.steps, DataFrame):
        x = F.least(F.greatest(F.lit(model.slope) * F.col("evidence") + model.offset, F.lit(-500.0)), F.lit(500.0))
        scored_rows = evidence_of(documents, model, text).withColumn("score", 1 / (1 + F.exp(-x))).drop("evidence")
        return scored_rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    there = model.in_tasks(documents.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = there()
        for texts in batches:
            yield pd.Series(np.zeros(len(texts)) if model.empty else model.score(model.evidence(list(texts))))

    return documents.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
