"""Words of identifiers: two splitters that are not to be confused."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to tell anything.
STOP_WORDS = (
    "self", "cls", "return", "def", "class", "the", "a", "an", "of", "to", "and", "or", "if", "is", "in", "for", "with", "value", "result", "none",
)


def tokenise(text: Column) -> Column:
    """Words of the identifiers in a text, lower-case, longer than one letter, without stop words.

    Identifiers are ASCII. Digits stay with the letters before them. A run of capitals before a
    capitalised word is parted from it first, so that the pattern needs no look-ahead.
    """
    names = F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), " ")
    parted = F.regexp_replace(names, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(parted, F.lit("[A-Z]?[a-z0-9]+|[A-Z]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(STOP_WORDS)))


def label_words(name: Column) -> Column:
    """Words for labels: digits apart from letters, no stop words, also parted at . _ - and /."""
    parted = F.regexp_replace(F.regexp_replace(name, r"[._\-/]", " "), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(parted, F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: F.length(w) > 1)
