"""Text as Column expressions: folding, title normalisation, tokens and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters; ß and œ stay."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def normalise(title: Column) -> Column:
    """A title for comparison: no trailing dots, apostrophes, marks or punctuation; single spaces."""
    x = F.regexp_replace(F.trim(title), r"[….\s]+$", "")
    x = F.regexp_replace(fold(x), "['’`]", "")
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def compact(text: Column) -> Column:
    """Letters and digits only, lower case, marks kept: how evaluation compares titles."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def token_dice(a: Column, b: Column) -> Column:
    """Twice the shared distinct words over the sum of both sides' distinct words."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def title_similarity(a: Column, b: Column, least_prefix: int = 8) -> Column:
    """Of normalised titles: 0 if either is empty, 1 if equal, 0.95 if the shorter (8 letters or more) begins the
    longer, else the better of edit similarity and word overlap."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when((F.length(shorter) >= least_prefix) & longer.startswith(shorter), F.lit(0.95))
        .otherwise(F.greatest(edit_similarity(a, b), token_dice(a, b)))
    )


def evaluation_similarity(a: Column, b: Column) -> Column:
    """Of compact titles: like edit similarity, and at least 0.8 where one of 3 letters or more lies in the other."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    edit = 1 - F.levenshtein(a, b) / long
    held = F.when(F.length(a) <= F.length(b), b.contains(a)).otherwise(a.contains(b))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when((short >= 3) & held, F.greatest(edit, 0.8 + 0.2 * short / long * 0.99)).otherwise(edit)
    )


def readable(text: Column) -> Column:
    """For readable equality: no invisible format or control characters, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s\x{00A0}]+", " "), r"[\p{Cf}\p{Cc}]", ""))
