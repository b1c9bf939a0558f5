"""Rule chains on pairs: the first rule that applies gives the reason.

Rules are columns; a chain is one ``coalesce``, so a pair is judged in one pass inside generated
code. Which words and patterns a chain uses are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.sets import words_present


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that is true, or null."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules])


def one_side_empty(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) == "") != (F.coalesce(b, F.lit("")) == "")


def both_differ(a: Column, b: Column, aliases: Sequence[tuple[str, str]] = ()) -> Column:
    """Both filled and different, unless they are an alias pair either way round."""
    same = F.lit(False)
    for x, y in aliases:
        same = same | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (a != "") & (b != "") & (a != b) & ~same


def opposed(a: Column, b: Column, word: str, other: str) -> Column:
    """One side has ``word``, the other ``other``, either way round."""
    return (F.contains(a, F.lit(word)) & F.contains(b, F.lit(other))) | (F.contains(a, F.lit(other)) & F.contains(b, F.lit(word)))


def word_sets_differ(a: Column, b: Column, words: list[str]) -> Column:
    """Both sides have some of the words, but not the same."""
    x, y = words_present(a, words), words_present(b, words)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def tokens_differ(a: Column, b: Column, pattern: str, ordered: bool = False) -> Column:
    """Both sides have tokens of the pattern's group 1, but not the same set (or list, if ``ordered``)."""
    x, y = (F.regexp_extract_all(c, F.lit(pattern), 1) for c in (a, b))
    if not ordered:
        x, y = F.array_sort(F.array_distinct(x)), F.array_sort(F.array_distinct(y))
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def one_side_only(a: Column, b: Column, words: list[str]) -> Column:
    """Some word is in one text only."""
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.contains(a, F.lit(w)) != F.contains(b, F.lit(w)))
    return hit


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (0 to 1); null if either is null. For pairs that blocking has left."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
