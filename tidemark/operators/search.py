"""Full-text search: query parsing, postings, BM25 ranking, phrases, prefixes, exclusion, excerpts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, tokens

K1, B = 1.2, 0.75
_folding = str.maketrans(MARKED, PLAIN)


@dataclass(frozen=True)
class Terms:
    words: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[tuple[str, ...], ...] = ()
    prefix_last: bool = False

    @property
    def searchable(self) -> bool:
        return sum(map(len, self.words)) + sum(len(w) for p in self.phrases for w in p) >= 2


def parse(typed: str) -> Terms:
    """Quotes make phrases (the last may stay open), a leading minus excludes, the last bare word is a prefix."""
    words, phrases, excluded, bare = [], [], [], False
    for minus, quoted, plain in re.findall(r'(-(?=\S))?(?:"([^"]*)(?:"|$)|([^\s"]+))', typed):
        found = tuple(re.findall(r"[^\W_]+", (quoted or plain).lower().translate(_folding)))
        if not found:
            continue
        if minus:
            excluded.append(found)
        elif quoted:
            phrases.append(found)
            bare = False
        else:
            words += found
            bare = True
    return Terms(tuple(words), tuple(phrases), tuple(excluded), bare)


def postings(docs: DataFrame, doc_id: str, fields: dict[str, str]) -> DataFrame:
    """(doc, field, pos, token) of the fields' columns."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), tokens(F.coalesce(F.col(column), F.lit(""))).alias("words")) for name, column in fields.items()])
    each = docs.select(F.col(doc_id).alias("doc"), F.explode(parts).alias("p")).select("doc", "p.field", F.posexplode("p.words").alias("pos", "token"))
    return each


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(token, n, docs): how often each word occurs, and in how many documents.

    Each row's words and its distinct words are counted in one aggregate that combines before the shuffle, so what is shuffled
    is of the size of the vocabulary. Words of ids with several rows are counted by id as well; null is no id.
    """
    split = docs.select(F.col(doc_id).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    told = lambda words, n, d: F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(n).cast("long").alias("n"), F.lit(d).cast("long").alias("docs")))
    counted = split.select(F.inline(F.concat(told(F.col("words"), 1, 0), told(F.array_distinct("words"), 0, F.col("doc").isNotNull()))))
    repeated = docs.groupBy(F.col(doc_id).alias("doc")).agg(F.count("*").alias("rows")).where("rows > 1").select("doc")
    again = split.join(repeated, "doc").select("doc", F.explode(F.array_distinct("words")).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("rows"))
    more = again.where("rows > 1").select("token", F.lit(0).cast("long").alias("n"), (1 - F.col("rows")).alias("docs"))
    return counted.unionByName(more).groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def holds(words: Column, terms: Terms) -> Column:
    """Whether a document's token array matches all words and phrases and none of the excluded."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    whole = lambda run: joined.contains(" " + " ".join(run) + " ")
    found = F.lit(True)
    for k, word in enumerate(terms.words):
        last = terms.prefix_last and k == len(terms.words) - 1
        found = found & (joined.contains(" " + word) if last else whole((word,)))
    for phrase in terms.phrases:
        found = found & whole(phrase)
    for run in terms.excluded:
        found = found & ~whole(run)
    return found


def ranked(docs: DataFrame, doc_id: str, fields: dict[str, tuple[str, float]], terms: Terms) -> DataFrame:
    """(doc, score) of matching documents by BM25 over weighted fields; higher is better.

    Two aggregates and no shuffle of documents: lengths and document frequencies of the query's few terms are counted
    in one pass, and each document is scored in place in the next.
    """
    names = list(fields)
    arrays = {n: tokens(F.coalesce(F.col(fields[n][0]), F.lit(""))) for n in names}
    every = docs.select(F.col(doc_id).alias("doc"), *[a.alias(n) for n, a in arrays.items()])
    size = sum((F.size(n) for n in names), F.lit(0))
    wanted = list(dict.fromkeys([*terms.words, *(w for p in terms.phrases for w in p)]))
    last = terms.words[-1] if terms.prefix_last and terms.words else None

    def count_of(word: str) -> Column:
        """The word's occurrences, weighted by field."""
        same = (lambda x: x.startswith(word)) if word == last else (lambda x: x == word)
        return sum((F.lit(fields[n][1]) * F.size(F.filter(n, same)) for n in names), F.lit(0.0))

    times = {w: count_of(w) for w in wanted}
    stats = every.agg(F.count("*").alias("n"), F.avg(size).alias("mean"), *[F.sum((times[w] > 0).cast("int")).alias(f"df{k}") for k, w in enumerate(wanted)]).first()
    n, mean, score = stats["n"], stats["mean"] or 1.0, F.lit(0.0)
    for k, w in enumerate(wanted):
        df = stats[f"df{k}"] or 0
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        score = score + idf * times[w] * (K1 + 1) / (times[w] + K1 * (1 - B + B * size / mean))
    together = F.concat(*[F.concat(F.col(n), F.array(F.lit("\n"))) for n in names])
    return every.where(holds(together, terms)).select("doc", score.alias("score"))


def excerpt(text: Column, word: str, length: int = 140) -> Column:
    """At most ``length`` characters that begin a third before the first match."""
    at = F.locate(word, F.lower(text))
    start = F.greatest(F.lit(1), at - length // 3)
    return F.when(at > 0, text.substr(start, F.lit(length))).otherwise(F.substring(text, 1, length))


# Documents, filters and marks

#: Which kinds of items each choice of kind stands for.
KIND_MAP = {"appointments": ("appointment",), "tasks": ("task", "deadline"), "reminders": ("reminder",)}


def item_documents(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item, title, aliases, notes, place, people) to search: items that are not merged, with their other spellings."""
    other = aliases.join(items.select("item", F.col("title").alias("_t")), "item").where(F.col("spelling") != F.col("_t"))
    joined = other.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("spelling")), " ").alias("aliases"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    kept = items.where("status <> 'merged'").join(joined, "item", "left")
    return kept.select("item", "title", blank(F.col("aliases")).alias("aliases"), blank(F.col("notes")).alias("notes"), blank(F.col("place")).alias("place"), blank(F.array_join("people", " ")).alias("people"))


def capture_documents(lines: DataFrame) -> DataFrame:
    """(image, text): a picture's lines in order, one below the other; pictures without text have none."""
    met = lines.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return met.where(F.col("text") != "")


def kinds_of(chosen: tuple[str, ...]) -> tuple[bool, tuple[str, ...]]:
    """Whether items are searched at all for the chosen kinds, and which kinds of items; captures are no items, nothing chosen is all."""
    return not chosen or any(c in KIND_MAP for c in chosen), tuple(k for c in chosen for k in KIND_MAP.get(c, ()))


def item_filter(chosen: tuple[str, ...] = (), context: str | None = "any", dates: tuple | None = None, dismissed: bool = False) -> Column:
    """The condition of a search on items: kinds, context (``any``, null for none, or an id), dates of their moments, and state."""
    out = F.col("status").isin("active", "dismissed") if dismissed else F.col("status") == "active"
    items, kinds = kinds_of(chosen)
    if not items:
        return F.lit(False)
    if kinds:
        out = out & F.col("kind").isin(*kinds)
    if context != "any":
        out = out & F.col("context").eqNullSafe(F.lit(context))
    if dates:
        out = out & F.when(F.col("family") == "event", F.col("start")).otherwise(F.coalesce("due", "start")).between(*map(F.lit, dates))
    return out


def might_match(text: Column, words: tuple[str, ...]) -> Column:
    """A cheap test before words are split: plain ASCII text that holds none of the words, if they are ASCII, cannot match."""
    if not all(w.isascii() for w in words):
        return F.lit(True)
    found = F.lit(False)
    for w in words:
        found = found | F.lower(text).contains(w)
    return text.rlike(r"[^\x00-\x7F]") | found


def marks(text: Column, terms: Terms) -> Column:
    """The words of a text that match: equal to a word of the query or of a phrase, or beginning with the last word; in order."""
    last = terms.words[-1] if terms.prefix_last and terms.words else None
    whole = {w for p in terms.phrases for w in p} | set(terms.words[:-1] if last else terms.words)
    fits = lambda t: (t.isin(*whole) if whole else F.lit(False)) | (t.startswith(last) if last else F.lit(False))
    return F.filter(tokens(text), fits)


def viewer(lines: DataFrame, terms: Terms) -> DataFrame:
    """(image, n, text, marks): all lines of pictures with their marks; lines without any have none."""
    words = tuple(dict.fromkeys([*terms.words, *(w for p in terms.phrases for w in p)]))
    return lines.withColumn("marks", F.when(might_match(F.col("text"), words), marks(F.col("text"), terms)).otherwise(F.array().cast("array<string>"))).select("image", "n", "text", "marks")


def restricted(rows: DataFrame, hits: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """``rows`` that are among the best ``most`` of the (key, score) hits, with their ``place``, best first."""
    best = hits.orderBy(F.col("score").desc(), key).limit(most).agg(F.collect_list(key).alias("_k"))  # at most ``most`` keys
    placed = best.select(F.posexplode("_k").alias("place", key))
    return rows.join(F.broadcast(placed), key).orderBy("place")


# A stored index

#: Folders of postings: a word's folder follows from its first two letters, so prefixes find theirs too.
BUCKETS = 256


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


#: Words that are met in a task before their postings are written.
MET = 2_000_000
#: Postings of one word in one field of some documents: their ids, how often each has it, and its places, as little-endian numbers.
POSTINGS = "token string, field int, weight double, first long, docs binary, times binary, places binary"
NO_ID = np.iinfo(np.int64).min


def _bytes(values: np.ndarray, ends: np.ndarray, kind: str) -> pa.Array:
    """One binary value for each run of ``values`` that ends at ``ends``."""
    packed, at = values.astype(kind), np.append(0, ends) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(packed)])


def _posted(words: pa.ListArray, doc: np.ndarray, field: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of some rows' words, and those of the empty word, which are the documents' sizes."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    met = words.flatten().dictionary_encode()
    kinds = max(1, len(met.dictionary))
    key = field[row].astype(np.int64) * kinds + met.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")  # rows and places stay in order
    key, row, pos = key[order], row[order], (np.arange(len(row)) - starts[row])[order]
    last = lambda changes, n: np.append(np.flatnonzero(changes) + 1, n) if n else np.empty(0, np.int64)
    pairs = last((key[1:] != key[:-1]) | (row[1:] != row[:-1]), len(key))  # ends of a word in a row
    told, holder = key[pairs - 1], row[pairs - 1]
    runs = last(told[1:] != told[:-1], len(told))  # ends of a word
    of = told[runs - 1]

    def batch(token, of, docs, times, places, runs, upto):
        columns = [token, pa.array(of.astype(np.int32)), pa.array(weights[of]), pa.array(docs[np.append(0, runs[:-1])] if len(runs) else docs[:0])]
        packed = [x.cast(pa.binary()) for x in (_bytes(docs, runs, "<i8"), _bytes(times, runs, "<i4"), _bytes(places, upto, "<i4"))]
        return pa.RecordBatch.from_arrays([*columns, *packed], ["token", "field", "weight", "first", "docs", "times", "places"])

    token = met.dictionary.take(pa.array(of % kinds)).cast(pa.string())
    yield batch(token, of // kinds, doc[holder], np.diff(pairs, prepend=0), pos, runs, pairs[runs - 1])
    for k in np.unique(field):
        mine = np.flatnonzero(field == k)
        one = np.array([len(mine)])
        yield batch(pa.array([""]), np.array([k]), doc[mine], sizes[mine], sizes[:0], one, np.array([0]))


def write_index(docs: DataFrame, doc_id: str, fields: dict[str, tuple[str, float]], path: str) -> None:
    """Stores the fields' (column, weight) words below ``path``: postings by folder, documents' sizes, and one row of totals.

    Texts are split once, and a task groups the words of its own rows, some ``MET`` at a time: only rows of a word with all its documents
    there and its places in them are shuffled, into folders that hold about one 256th of the words. Sizes are the postings of
    the empty word, in a folder of their own.
    """
    spark, weights = docs.sparkSession, np.array([float(w) for _, w in fields.values()])
    parts = F.array(*[F.struct(F.lit(k).alias("field"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("words")) for k, (c, _) in enumerate(fields.values())])
    each = docs.select(F.col(doc_id).cast("long").alias("doc"), F.explode(parts).alias("p")).select("doc", "p.*")

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            total, at = np.cumsum(rows["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while at < rows.num_rows:
                done = total[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(total, done + MET, side="right")))
                part = rows.slice(at, upto - at)
                yield from _posted(part["words"], part["doc"].fill_null(NO_ID).to_numpy(), part["field"].to_numpy(), weights)
                at = upto

    met = each.mapInArrow(posted, POSTINGS).withColumn("bucket", F.when(F.col("token") == "", -1).otherwise(_bucket(F.col("token"))))
    met.repartition("bucket", F.pmod(F.xxhash64("token", "first"), F.lit(8))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    _sizes(spark, path).agg(F.count("*").alias("n"), F.avg("size").alias("mean")).write.parquet(f"{path}/totals")


def _unpacked(postings: DataFrame, places: bool) -> DataFrame:
    """(doc, field, weight, times) of stored postings, a row for each document, with ``places`` if asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, times = np.frombuffer(batch["docs"][k].as_py(), "<i8"), np.frombuffer(batch["times"][k].as_py(), "<i4")
                n = len(doc)
                columns = [pa.array(doc, mask=doc == NO_ID), pa.array(np.full(n, batch["field"][k].as_py(), np.int32)), pa.array(np.full(n, batch["weight"][k].as_py())), pa.array(times)]
                if places:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)).astype(np.int32)), pa.array(np.frombuffer(batch["places"][k].as_py(), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "field", "weight", "times", "places"][: len(columns)])

    read = postings.select("field", "weight", "docs", "times", *(["places"] if places else []))
    return read.mapInArrow(rows, "doc long, field int, weight double, times int" + (", places array<int>" if places else ""))


def _stored(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{path}/postings")


def _sizes(spark, path: str) -> DataFrame:
    """(doc, size): how many words a document has in all its fields."""
    return _unpacked(_stored(spark, path).where("bucket = -1"), False).groupBy("doc").agg(F.sum("times").alias("size"))


class Index:
    """A stored index, opened once; a search reads the folders of its words only."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.totals = spark.read.parquet(f"{path}/totals").first()

    def _postings(self, word: str, prefix: bool = False, places: bool = False) -> DataFrame:
        """(doc, field, weight, times) of a word, or of all that begin with it, with its ``places`` if asked for."""
        every = _stored(self.spark, self.path).where("bucket >= 0")
        if not prefix or len(word) >= 2:
            bucket = self.spark.range(1).select(_bucket(F.lit(word))).first()[0]
            every = every.where(F.col("bucket") == bucket)
        return _unpacked(every.where(F.col("token").startswith(word) if prefix else F.col("token") == word), places)

    def _term(self, run: tuple[str, ...], prefix: bool = False) -> DataFrame:
        """(doc, tf) of documents that hold the word, or the words one after another: occurrences weighted by field."""
        if len(run) == 1:
            return self._postings(run[0], prefix).groupBy("doc").agg(F.sum(F.col("weight") * F.col("times")).alias("tf"))
        found = self._placed(run[0], 0)
        for k, word in enumerate(run[1:], 1):
            found = found.join(self._placed(word, k).select("doc", "field", F.col("places").alias("_p")), ["doc", "field"]).withColumn("places", F.array_intersect("places", "_p")).drop("_p")
        return found.where(F.size("places") > 0).groupBy("doc").agg(F.sum(F.col("weight") * F.size("places")).alias("tf"))

    def _placed(self, word: str, by: int) -> DataFrame:
        """A word's postings, one for each document and field, with places moved back."""
        met = self._postings(word, places=True).groupBy("doc", "field", "weight").agg(F.flatten(F.collect_list("places")).alias("places"))
        return met.withColumn("places", F.transform("places", lambda p: p - by))

    def search(self, terms: Terms) -> DataFrame:
        """(doc, score) of documents with all words and phrases and none of what is excluded, by BM25; a phrase is one term."""
        runs = list(dict.fromkeys([*((w,) for w in terms.words), *terms.phrases]))
        last = (terms.words[-1],) if terms.prefix_last and terms.words else None
        n, mean = self.totals["n"], self.totals["mean"] or 1.0
        out = None
        for k, run in enumerate(runs):
            term = self._term(run, run == last)
            df = term.count()
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            term = term.select("doc", F.col("tf").alias(f"_tf{k}"))
            out = (term if out is None else out.join(term, "doc")).withColumn(f"_idf{k}", F.lit(idf))
        if out is None:
            return self.spark.createDataFrame([], "doc long, score double")
        for run in terms.excluded:
            out = out.join(self._term(run).select("doc"), "doc", "left_anti")
        out = out.join(_sizes(self.spark, self.path), "doc")
        score = F.lit(0.0)
        for k in range(len(runs)):
            tf = F.col(f"_tf{k}")
            score = score + F.col(f"_idf{k}") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / mean))
        return out.select("doc", score.alias("score"))
