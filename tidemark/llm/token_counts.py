"""Token counts by prefix dynamic programming.

For byte-level BPE files the count at every prefix of a piece follows from counts at shorter prefixes (see
``bpe.Pieces``); a text's table adds up its pieces' tables. A stored table answers how many tokens any prefix has
and how long a prefix fits a budget, without encoding again. For sentencepiece models the library counts whole
texts and, where tables are asked for, prefixes one by one.

Defined results: a null text is empty (0 tokens, table [0]); texts of any length are taken whole; each row gives one
row, repeated rows included; an empty table gives no rows. Other columns are passed on, except those whose names the
operator's own columns take.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pieces_of


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    return pieces_of(path).count


def count_tokens(documents: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds ``out``: the number of tokens of the whole text."""

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(path)
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn(out, counted(F.col(text)))


def prefix_tables(documents: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds ``out``: token counts of the prefixes of 0, 1, ... characters."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tabled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path.endswith(".model"):
            count = _counter(path)
            table = lambda t: [count(t[:p]) for p in range(len(t) + 1)]
        else:
            table = pieces_of(path).table_of
        for texts in batches:
            yield pd.Series([table(t) if t else [0] for t in texts])

    return documents.withColumn(out, tabled(F.col(text)))


def fitting_prefix(table: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from a stored table."""

    @F.pandas_udf(T.LongType())
    def fits(tables: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([max((p for p, c in enumerate(t) if c <= b), default=0) for t, b in zip(tables, budgets, strict=True)], dtype="int64")

    return fits(table, budget)


def tokens_before(table: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from a stored table."""
    return F.element_at(table, F.least(F.greatest(chars, F.lit(0)), F.size(table) - 1).cast("int") + 1)
