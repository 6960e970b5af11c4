"""Words of texts as Column expressions: maximal runs of characters other than blanks (space, tab, \\n, \\v, \\f, \\r)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that part words, as a class of a regular expression.
BLANK = r"\x20\x09-\x0D"
_BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text that isn't null, in order."""
    bare = F.trim(text, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK}]+"))


def pieces(text: Column, size: int) -> Column:
    """The text cut into pieces of about `size` characters that together have the same words in the same order.

    A piece has the words that begin within its stretch of the text, each of them whole. A short text is one piece.
    """

    def piece(i: Column) -> Column:
        begin = (i * size).cast("int")
        own = F.substring(text, begin + 1, F.lit(size))
        own = F.when((i > 0) & F.substring(text, begin, F.lit(1)).rlike(f"[^{BLANK}]"), F.regexp_replace(own, rf"\A[^{BLANK}]+", "")).otherwise(own)
        rest = F.regexp_extract(F.substring(text, begin + size + 1, F.length(text)), rf"\A[^{BLANK}]+", 0)
        return let(own, lambda x: F.when(x.rlike(rf"[^{BLANK}]\z"), F.concat(x, rest)).otherwise(x))

    n = F.floor((F.length(text) - 1) / size)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n), piece))


def times_of(text: Column, characters: str) -> Column:
    """How often characters of a class of a regular expression stand in the text."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("long")
