"""Columns over the code points and grapheme clusters of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_STRINGS = "array<string>"


def folded(s: Column, case_insensitive: bool) -> Column:
    """``s``, lower-cased by the full Unicode mapping if asked."""
    return F.lower(s) if case_insensitive else s


def chars(s: Column) -> Column:
    """Code points of ``s`` as an array; empty for an empty string, null for null."""
    return F.when(s == "", F.array().cast(_NO_STRINGS)).otherwise(F.split(s, ""))


def clip(v: Column) -> Column:
    """``v`` limited to 0 and 1."""
    return F.when(v < 0, F.lit(0.0)).when(v > 1, F.lit(1.0)).otherwise(v)


def six_places(v: Column) -> Column:
    """``round(round(v, 9), 6)`` by whole numbers: rounding a double goes through decimals, which cost more than most scorers.

    Where the tenth place is so near a five that binary fractions may tip it, and outside 0 and 1, decimals decide.
    ``v`` is named several times, so it should be worked out before.
    """
    up = v * 1e9 + 0.5
    sure = (v >= 0) & (v <= 1) & (F.abs(up - F.rint(up)) > 1e-4)
    return F.when(sure, F.floor((F.floor(up) + 500) / 1000) / 1e6).otherwise(F.round(F.round(v, 9), 6))


def longest(x: Column, y: Column) -> Column:
    """Length in code points of the longer string."""
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(F.char_length(x), F.char_length(y)))


def common_prefix(x: Column, y: Column, most: int | None = None) -> Column:
    """Length in code points of the common prefix, ``most`` at most.

    The first unequal place is found on the two code point arrays, whose lengths bound the search.
    """
    size = F.least(F.char_length(x), F.char_length(y), *([F.lit(most)] if most is not None else []))
    size = F.when(x.isNotNull() & y.isNotNull(), size)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    return F.when(size.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, size))


def grams(s: Column, n: int, before: int, after: int) -> Column:
    """All windows of ``n`` code points of ``s``, padded with spaces."""
    padded = F.concat(F.lit(" " * before), s, F.lit(" " * after))
    last = F.char_length(padded) - (n - 1)
    # The padded string is bound once, not made anew for each window.
    windows = F.get(F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))), F.lit(0))
    return F.when(last.isNull(), F.lit(None).cast(_NO_STRINGS)).when(last < 1, F.array().cast(_NO_STRINGS)).otherwise(windows)


#: What transcription tokenising ignores besides white space and numbers.
IGNORED_MARKS, IGNORED_STRESS = r"\[\]/\\.,;:()|{}<>\"'\-+", "ˈˌːˑ‖‿"
IGNORED_PATTERN = r"^[\p{IsWhite_Space}\p{N}" + IGNORED_MARKS + IGNORED_STRESS + "]+$"


def sounds(s: Column) -> Column:
    """Extended grapheme clusters of ``s`` but those made of ignored characters only."""
    return F.filter(F.regexp_extract_all(s, F.lit(r"\X"), F.lit(0)), lambda g: ~g.rlike(IGNORED_PATTERN))


def letters(s: Column) -> Column:
    """ASCII letters of ``s`` as one lower-case string; other characters are dropped before lowering."""
    return F.lower(F.regexp_replace(s, "[^A-Za-z]", ""))
