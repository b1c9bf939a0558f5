"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that counts as white space around a value, Unicode spaces and invisible marks included.
_EDGES = "\t\n\x0b\x0c\r \x85\xa0\xad\u1680\u180e\u2028\u2029\u202a\u202b\u202c\u202d\u202e\u202f\u3000\ufeff" + "".join(map(chr, [*range(0x2000, 0x2010), *range(0x205F, 0x2065)]))
_EDGE = f"[{_EDGES}]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.btrim(c.cast("string"), F.lit(_EDGES))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null itself."""
    # Trimmed on the left alone: that ends at the first character which is no white space, however long the text.
    return F.coalesce(F.ltrim(c.cast("string"), F.lit(_EDGES)) == "", F.lit(True))


def narrow_digits(c: Column) -> Column:
    """Full-width digits and the signs of dates and numbers as their ASCII forms."""
    narrow = F.translate(c, "０１２３４５６７８９／－．，：＋￥　", "0123456789/-.,:+¥ ")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(narrow)  # ASCII holds none of them


#: Words and signs that stand for "none", "unknown" or "still open"; compared in lower case, without white space. Fixed values.
PLACEHOLDERS = (
    "-", "--", "---", "—", "——", "/", "//", "\\", "?", "??", "???", ".", "..", "...", "*", "**", "_", "~", "#", "xxx",
    "n/a", "na", "n.a.", "#n/a", "nil", "none", "null", "nan", "nat", "undefined", "unknown", "tbd", "tbc", "tba", "todo", "pending",
    "无", "無", "没有", "空", "暂无", "未知", "不详", "不明", "未定", "待定", "待确认", "待补充", "待查", "待议", "另议", "面议", "询价", "暂缺", "未填", "未填写",
)


def is_unfilled(c: Column) -> Column:
    """Blank, or a placeholder."""
    bare = F.lower(F.regexp_replace(F.translate(c, "／－？＊．　", "/-?*. "), _EDGE, ""))
    return F.coalesce((bare == "") | bare.isin(*PLACEHOLDERS), F.lit(True))


#: Signs that count as one and the same in names and descriptions, and what they become. Fixed values.
_SIGNS_FROM, _SIGNS_TO = "（），：×—φø", "(),:x-ΦΦ"


def plain_form(c: Column) -> Column:
    """Lower case, trimmed, runs of ASCII white space as one space, look-alike signs unified; null gives an empty text."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.translate(s, _SIGNS_FROM, _SIGNS_TO)


#: Signs that ``bare_form`` leaves out besides white space; all others, such as * + % # and =, are kept. Fixed values.
_LEFT_OUT = r"\-_/\\(),;:.，：；、。{}\[\]<>"


def bare_form(c: Column) -> Column:
    """``plain_form`` without white space and separating punctuation; a decimal point between digits stays apart as DOT."""
    dotted = F.regexp_replace(plain_form(c), r"(?<=\d)\.(?=\d)", "DOT")
    return F.regexp_replace(dotted, rf"(?U)[\s{_LEFT_OUT}]+", "")


#: Endings of company names, taken out in this order. Fixed values.
COMPANY_WORDS = ("有限公司", "(中国)", "股份", "有限责任公司", "集团", "公司")


def company_name(c: Column) -> Column:
    """A name without the words for the form of the company; null gives an empty text."""
    out = F.trim(F.coalesce(c, F.lit("")))
    for word in COMPANY_WORDS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.trim(out)


def masked_secret(c: Column, shown: int = 4) -> Column:
    """Only the last ``shown`` characters of a secret, asterisks before them; a short one is all asterisks, null stays null."""
    return F.when(F.length(c) > 2 * shown, F.concat(F.repeat(F.lit("*"), F.length(c) - shown), F.right(c, F.lit(shown)))).otherwise(F.repeat(F.lit("*"), F.length(c)))


def money_text(c: Column) -> Column:
    """A number with thousands commas and two places, a dash for null."""
    return F.when(c.isNull() | F.isnan(c), F.lit("—")).otherwise(F.format_number(c, 2))


def number_set(c: Column) -> Column:
    """Distinct number strings of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1)))


def keyword_flag(text: Column, include: list[str], exclude: list[str]) -> Column:
    """False if any excluded word occurs, else whether any included one does; letter case is ignored, null is false."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(t, w)) if words else F.lit(False)
    return F.when(has(exclude), False).otherwise(has(include))


def labelled(text: Column, *labels: str, least: int = 3, most: int = 499) -> Column:
    """What follows the first of the labels that occurs on its line, white space collapsed, if its length is within bounds."""
    found = None
    for label in labels:
        hit = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?m){label}\s*[:：]?[ \t]*([^\r\n]*)", 1), r"\s+", " "))
        hit = F.when(F.length(hit).between(least, most), hit)
        found = hit if found is None else F.coalesce(found, hit)
    return found


def labelled_counts(text: Column, labels: list[str]) -> Column:
    """map(label -> integer that follows it); labels that do not occur are left out."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[F.regexp_extract(text, rf"{label}\s*[:：(（]?\s*(\d+)", 1).try_cast("int") for label in labels]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def first_match(patterns: list[tuple[Column, str]]) -> Column:
    """The first non-empty match of (text, pattern with one group) in order."""
    return F.coalesce(*[F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1)) for t, p in patterns])


def named_value(items: Column, name: str) -> Column:
    """The value of the first struct(name, value) of an array with that name; null without one."""
    return F.try_element_at(F.filter(items, lambda x: x["name"] == name), F.lit(1))["value"]
