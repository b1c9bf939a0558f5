"""One form for texts that look the same.

Distinct texts are exploded to positioned code points; a broadcast join takes every code point to
what it looks like (its decomposition, its Latin twin, a plain space or hyphen, or nothing);
combining marks are ordered by class behind their base; base and marks are composed again; and the
strings are rebuilt. The two tables that are broadcast hold Unicode's own mappings, fewer than
20,000 rows whatever the data. Texts of printable ASCII and of common Chinese characters alone are
already in that form and are never exploded; in other texts a run of such characters stays one piece.

The tables are derived from Python's ``unicodedata`` on the driver; only the twins of Latin letters
and a few radicals, which it does not hold, are listed here.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Letters of other scripts and the Latin letters they look like. Fixed values.
TWINS = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ι": "i", "κ": "k",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G", "ԍ": "ɢ",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k",
    # Armenian
    "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ꭱ": "R", "Ꮢ": "R", "Ꮤ": "W", "Ꮍ": "Y", "Ꭵ": "i",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x", "ⲓ": "i", "ⲕ": "k",
    # Latin letters of their own code point
    "ɡ": "g", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
#: Radicals for which Unicode gives no decomposition, and the characters they stand for. Fixed values.
RADICALS = {
    "⺁": "厂", "⺅": "亻", "⺆": "冂", "⺉": "刂", "⺘": "扌", "⺙": "攵", "⺡": "氵", "⺣": "灬", "⺨": "犭", "⺭": "礻", "⺰": "纟", "⻂": "衤", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车",
    "⻌": "辶", "⻓": "长", "⻔": "门", "⻘": "青", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦",
    "⻩": "黄", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}
#: Hyphens and what looks like one. Fixed values.
HYPHENS = "‐‑‒–⁃−˗֊﹣－➖"
#: Compatibility decompositions that change the look: these forms stay as they are. Fixed values.
_VISIBLE_FORMS = ("<super>", "<sub>", "<fraction>", "<circle>", "<vertical>")
_LAST = 0x110000
_CJK = range(0x4E00, 0xA000)


def _invisible(c: str) -> bool:
    n = ord(c)
    return (
        unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\x0b\x0c\x85"
        or n in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180F
    )


def looks_like(c: str) -> str:
    """What one code point looks like, fully decomposed; an empty string for an invisible one."""
    if _invisible(c):
        return ""
    if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\r\x0b\x0c\x85⠀":
        return " "
    if c in HYPHENS:
        return "-"
    c = RADICALS.get(c, c)
    if c in TWINS:
        return TWINS[c]
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return unicodedata.normalize("NFD", c)
    form = unicodedata.decomposition(c)
    if not form:
        return c
    parts = form.split()
    if parts[0].startswith("<"):
        # A spacing accent decomposes to a space and a mark, which would not look the same.
        if parts[0] in _VISIBLE_FORMS or parts[1:2] == ["0020"]:
            return c
        parts = parts[1:]
    return "".join(looks_like(chr(int(p, 16))) for p in parts)


def _code_points():
    return (chr(n) for n in range(_LAST) if not 0xD800 <= n < 0xE000 and n not in _CJK)


@lru_cache(maxsize=1)
def _mapping() -> pa.Table:
    """(code point, [(code point, combining class)]) for every code point that changes or combines."""
    ch, to = [], []
    for c in _code_points():
        looks = looks_like(c)
        if looks != c or unicodedata.combining(c):
            ch.append(c)
            to.append([{"c": x, "ccc": unicodedata.combining(x)} for x in looks])
    return pa.table({"ch": ch, "to": pa.array(to, pa.list_(pa.struct([("c", pa.string()), ("ccc", pa.int32())])))})


@lru_cache(maxsize=1)
def _compositions() -> pa.Table:
    """(base and marks in order, composed) for every composed character of Unicode, Hangul syllables included."""
    apart, composed = [], []
    for c in _code_points():
        nfd = unicodedata.normalize("NFD", c)
        if nfd != c and len(nfd) > 1 and unicodedata.normalize("NFC", nfd) == c:
            apart.append(nfd)
            composed.append(c)
    return pa.table({"apart": apart, "composed": composed})


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return F.broadcast(spark.createDataFrame(_mapping())), F.broadcast(spark.createDataFrame(_compositions()))


#: Printable ASCII and common Chinese characters look like themselves and compose with nothing before them.
_PLAIN = r"\x20-\x7E一-鿿"
#: Only texts with anything else are exploded.
_TO_EXPLODE = f"[^{_PLAIN}]"
#: The pieces a text is exploded to: a run of plain characters up to the last one before another character, which may carry a mark, and every other code point by itself.
_PIECES = rf"[{_PLAIN}]+(?=[{_PLAIN}]|\z)|[\s\S]"
_JAMO_TAIL = r"^[ᅡ-ᅵᆨ-ᇂ]$"


def visual_forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, form) for each distinct non-null value of ``text``; form is what the text looks like.

    Empty texts have the empty form; a text of invisible characters alone too. Marks without a base
    stay at the start. Long texts are exploded whole; a group here is one text, never more.
    """
    mapping, composed = _tables(texts.sparkSession)
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    plain = distinct.where(~F.col("text").rlike(_TO_EXPLODE)).select("text", F.col("text").alias("form"))
    # 16 bytes stand for a text in the shuffles; the text itself is joined back once.
    key = F.unhex(F.md5("text"))
    special = distinct.where(F.col("text").rlike(_TO_EXPLODE))
    points = special.select(key.alias("id"), F.posexplode(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))).alias("pos", "ch"))
    mapped = points.join(mapping, "ch", "left").select(
        "id", "pos", F.posexplode(F.coalesce("to", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))).alias("sub", "m")
    )
    # Vowels and tails of Korean syllables belong to the leading consonant before them.
    follows = (F.col("m.ccc") > 0) | F.col("m.c").rlike(_JAMO_TAIL)
    in_text = W.partitionBy("id").orderBy("pos", "sub")
    bases = mapped.select("id", "pos", "sub", "m", F.sum(F.when(follows, 0).otherwise(1)).over(in_text).alias("base"))
    # Marks in the order of their class, those of one class as written; the base is of class 0.
    ordered = bases.groupBy("id", "base").agg(F.array_sort(F.collect_list(F.struct("m.ccc", "pos", "sub", "m.c"))).alias("marks"))
    # A Korean syllable is composed by itself, whatever marks follow it; any other base with its marks. A base alone composes with nothing.
    head = F.filter("marks", lambda m: m["ccc"] == 0)
    several = F.when(F.size("marks") > 1, F.array_join(F.when(F.size(head) > 1, head).otherwise(F.col("marks"))["c"], ""))
    whole = ordered.select("id", "base", "marks", (F.size(head) > 1).alias("korean"), several.alias("apart")).join(composed, "apart", "left")
    marks_behind = F.array_join(F.filter("marks", lambda m: m["ccc"] > 0)["c"], "")
    piece = (
        F.when(F.size("marks") == 1, F.element_at("marks", 1)["c"])
        .when(F.col("korean"), F.concat(F.coalesce("composed", "apart"), marks_behind))
        .when(F.col("composed").isNotNull(), F.col("composed"))
        .otherwise(_compose_prefix(F.col("marks")))
    )
    rebuilt = whole.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", piece.alias("s")))), lambda x: x["s"]), "").alias("form"))
    out = special.select("text", key.alias("id")).join(rebuilt, "id", "left").select("text", F.coalesce("form", F.lit("")).alias("form"))
    return plain.unionByName(out)


@lru_cache(maxsize=1)
def _pairs() -> str:
    """Base, mark and composed character of every pair of two code points that is not Hangul, each behind a separator."""
    pairs = []
    for n in range(_LAST):
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n < 0xE000 or n in _CJK:
            continue
        c = chr(n)
        form = unicodedata.decomposition(c)
        if form and not form.startswith("<") and " " in form and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c:
            pairs.append("\x00" + "".join(chr(int(p, 16)) for p in form.split()) + c)
    return "".join(pairs)


def _compose_prefix(marks: Column) -> Column:
    """Base and sorted marks where no single character has them all: each mark that can is composed with the base.

    A mark is blocked by an uncomposed one of its own class before it. Only the few such clusters
    are looked up, in one text that holds all pairs.
    """
    pairs = F.lit(_pairs())
    start = F.struct(F.element_at(marks, 1)["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def add(acc: Column, m: Column) -> Column:
        at = F.instr(pairs, F.concat(F.lit("\x00"), acc["base"], m["c"]))
        made = F.when(((acc["rest"] == "") | (acc["last"] < m["ccc"])) & (at > 0), F.substring(pairs, at + 3, F.lit(1)))
        return F.when(made.isNotNull(), F.struct(made.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["base"].alias("base"), F.concat(acc["rest"], m["c"]).alias("rest"), m["ccc"].alias("last"))
        )

    done = F.aggregate(F.slice(marks, 2, F.size(marks)), start, add)
    return F.concat(done["base"], done["rest"])


def _digest(columns: list[str]) -> Column:
    """16 bytes that stand for the texts of several columns; the lengths keep apart what would run together."""
    return F.unhex(F.md5(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns])))


def looks(rows: DataFrame, *, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(k, look, raw): of each distinct row its key, what its ``fields`` look like together, and the texts as written, both as digests.

    Rows of one look are the same to the eye; among them those of one raw have the very same texts.
    Null and empty count as the same; rows whose fields all are blank to the eye, or without key,
    take no part. Repeated rows count once; other columns are not read.
    """
    flat = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)]).distinct()
    names = [f"f{i}" for i in range(len(fields))]
    seen = [f"v{i}" for i in range(len(fields))]
    # Read once for every field.
    forms = cut_lineage(visual_forms(flat.select(F.explode(F.array(*names)).alias("text"))))
    for f, v in zip(names, seen):
        flat = flat.join(forms.select(F.col("text").alias(f), F.col("form").alias(v)), f)
    return flat.where(F.trim(F.concat(*seen)) != "").select("k", _digest(seen).alias("look"), _digest(names).alias("raw"))


def look_links(seen: DataFrame) -> DataFrame:
    """(look, raw_a, raw_b): the classes, each of the rows of ``looks`` with one look and raw, that look the same but are written differently."""
    classes = seen.groupBy("look", "raw").agg(F.lit(1).alias("one")).drop("one")
    pairs = classes.alias("x").join(classes.alias("y"), F.expr("x.look = y.look and x.raw < y.raw"))
    return pairs.select(F.col("x.look").alias("look"), F.col("x.raw").alias("raw_a"), F.col("y.raw").alias("raw_b"))


def same_to_the_eye(rows: DataFrame, *, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(code_a, code_b), smaller first: different keys all of whose ``fields`` look the same while at least one differs in a character.

    Who takes part: see ``looks``. Keys with the very same texts form one class and only classes
    that differ are joined; whoever needs no pairs reads ``looks`` and ``look_links`` instead.
    """
    seen = cut_lineage(looks(rows, key=key, fields=fields))
    a = seen.select("look", F.col("raw").alias("raw_a"), F.col("k").alias("ka"))
    b = seen.select("look", F.col("raw").alias("raw_b"), F.col("k").alias("kb"))
    found = look_links(seen).join(a, ["look", "raw_a"]).join(b, ["look", "raw_b"]).where("ka <> kb")
    return found.select(F.least("ka", "kb").alias("code_a"), F.greatest("ka", "kb").alias("code_b")).distinct()
