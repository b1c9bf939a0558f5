"""Numbers in text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import narrow_digits


def parse_number(c: Column) -> Column:
    """A whole-text number as double: currency signs, ``元``, thousands commas and spaces are dropped,
    ``(5)`` is -5; other text gives null."""
    s = F.regexp_replace(narrow_digits(c), r"[¥$€元,\s]", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), s.try_cast("double"))


def round2(c: Column) -> Column:
    """Two places, halves towards positive infinity."""
    return F.floor(c * 100 + 0.5) / 100


def pct_change(old: Column, new: Column) -> Column:
    """(new - old) / old in percent; 0 where old is not above zero."""
    return F.when(old > 0, F.try_divide(new - old, old) * 100).otherwise(F.lit(0.0))


def first_number(c: Column) -> Column:
    """The first number anywhere in a text, rounded to two places; 万 or 万元 at its end multiplies by 10,000. Null without one."""
    s = F.regexp_replace(narrow_digits(c), r"[,\s]", "")
    n = F.regexp_extract(s, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return round2(F.when(s.rlike(r"万元?$"), n * 10000).otherwise(n))


def strict_number(c: Column) -> Column:
    """A text that is one number with proper thousands commas or none; anything else is null."""
    s = F.trim(c)
    return F.when(s.rlike(r"^[-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"), F.regexp_replace(s, ",", "").try_cast("double"))


def open_quantity(known: Column, ordered: Column, done: Column) -> Column:
    """The known open quantity, else what was ordered less what is done, at least 0; null if nothing was ordered."""
    return F.coalesce(known, F.when(ordered.isNotNull(), F.greatest(F.lit(0.0), ordered - F.coalesce(done, F.lit(0.0)))))


#: An amount with a currency word or sign behind it. Fixed value.
_AMOUNT = r"(\d+(?:\.\d+)?)\s*(?:元|块|¥|￥)"


def price_in_text(c: Column) -> Column:
    """The first amount with a currency sign or word behind it."""
    return F.regexp_extract(c, _AMOUNT, 1).try_cast("double")


def prices_in_text(c: Column) -> Column:
    """All such amounts in order; an empty array without one, also for null."""
    return F.transform(F.coalesce(F.regexp_extract_all(c, F.lit(_AMOUNT), F.lit(1)), F.array().cast("array<string>")), lambda x: x.try_cast("double"))


def price_stats(prices: Column) -> Column:
    """struct(n, mean, low, high) of an array of prices; mean, low and high are null without one."""
    n = F.size(prices)
    total = F.aggregate(prices, F.lit(0.0), lambda a, x: a + x)
    return F.struct(n.alias("n"), F.when(n > 0, total / n).alias("mean"), F.array_min(prices).alias("low"), F.array_max(prices).alias("high"))
