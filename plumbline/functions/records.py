"""Fields of company and court records in page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASE = r"([（(]\d{4}[）)][^\s（()）,，;；]{2,20}?\d+号)"


def case_numbers(text: Column) -> Column:
    """All case numbers of a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_CASE), 1))


def case_year(number: Column) -> Column:
    return F.regexp_extract(number, r"[（(](\d{4})[）)]", 1).try_cast("int")


def case_kind(number: Column) -> Column:
    """civil, criminal, administrative or enforcement by the sign in the number; null otherwise."""
    return F.when(F.contains(number, F.lit("民")), "civil").when(F.contains(number, F.lit("刑")), "criminal").when(F.contains(number, F.lit("行")), "administrative").when(F.contains(number, F.lit("执")), "enforcement")


def role_counts(text: Column, company: Column) -> dict[str, Column]:
    """Aggregates: records, those that name the company as plaintiff, and as defendant."""
    named = F.coalesce(F.contains(text, company), F.lit(False))
    has = lambda word: F.coalesce(F.contains(text, F.lit(word)), F.lit(False))
    return {"total": F.count(text), "as_plaintiff": F.count_if(named & has("原告")), "as_defendant": F.count_if(named & has("被告"))}


def search_keywords(company: Column, endings: list[str]) -> Column:
    """The company and its name with each ending, once each."""
    return F.array_distinct(F.array(company, *[F.concat(company, F.lit(" " + e)) for e in endings]))


def picked_titles(title: Column, include: str, exclude: str) -> Column:
    """Whether a title has one word and not another (an annual report and not its summary); null is false."""
    return F.coalesce(F.contains(title, F.lit(include)) & ~F.contains(title, F.lit(exclude)), F.lit(False))
