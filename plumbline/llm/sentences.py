"""Sentences of texts in many languages and scripts, in SQL expressions only.

End marks that end nothing (in numbers, labels, addresses, abbreviations, initials, list signs,
inside quotes, brackets and titles) are masked by a private-use placeholder of the same length, one
``regexp_replace`` after another. The space behind what is left of the end marks, around empty lines
and line breaks before list items, and between Thai letters is then set off by separators, the text
is split there into sentences and spaces by turns, and their lengths are added up. Masking never
changes the length, so the offsets are those of the text itself, from which the sentences are cut
again where they are asked for. Passes whose sign does not occur in a text are left out.

Bounds: round brackets are matched nested two deep, every other kind of pair one deep within its
own kind. Beyond that the marks inside end a sentence.

Everything happens in the row of the text: no shuffle, no Python.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

#: Private-use placeholders: a masked mark, an empty line, a line break before a list item, a separator, a mark that follows another in a run, an end mark of any kind, a ? or ! of an address.
_MASK, _PARA, _ITEM, _SEP, _MORE, _END, _ASKED = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"
#: White space but the line break: controls and all separators of Unicode.
_HSPACE = r"\t\x0b\x0c\r\x1c-\x1f\x85\p{Z}"
_WS = f"[{_HSPACE}\n]"
_HS = f"[{_HSPACE}]"
#: End marks of all scripts. Fixed values.
_MARKS = ".．。｡︒﹒!！﹗?？﹖…।॥؟۔։።‼⁇⁈⁉"
#: Scripts that are written without spaces between sentences, and Korean.
_CJK = "々〆〇ぁ-ゟ゠-ヿ㐀-䶿一-鿿\uf900-\ufaff가-힣"
#: Pairs of quotes, brackets and title signs, in the order in which they are matched. Fixed values.
_PAIRS = ["„“”", "“”", "‘’", '""', "「」", "『』", "《》", "〈〉", "【】", "〔〕", "[]", "{}", "«»", "‹›", "〝〞〟"]
#: Their private signs, all of which begin with the bytes EE 81 as no other private sign does.
_OPEN = [chr(0xE040 + 2 * i) for i in range(len(_PAIRS) + 2)]
_CLOSE = [chr(0xE041 + 2 * i) for i in range(len(_PAIRS) + 2)]
#: Kinds of pairs, by number, that are looked for together, and the first bytes that all their signs share, if any.
_TOGETHER = [((0, 1), b"\xe2\x80"), ((2,), b"\xe2\x80"), ((3,), b""), ((4, 5), b"\xe3\x80"), ((6, 7), b"\xe3\x80"), ((8, 9), b"\xe3\x80"), ((14,), b"\xe3\x80"), ((10, 11), b""), ((12, 13), b""), ((15, 16), b"")]
_CLOSERS = "".join(_CLOSE)
_TITLES = ("《》", "〈〉")
#: Abbreviations after which the sentence goes on whatever follows. Fixed values.
_GOES_ON = (
    "mr mrs ms mx dr prof st fig figs pos sec secs rev vs cf approx excl incl viz acc ref refs dept attn tel ext eq art vol chap app ed eds e\\.g i\\.e a\\.k\\.a "
    "hr fr fa abt abschn gem zzgl inkl exkl ca bzgl bzw vgl evtl ggf sog abb kap tab str u\\.a z\\.b d\\.h "
    "им рис табл см ок тел ул просп т\\.е напр "
    "रु क्र डॉ श्री सं पृ कि ग्रा मि मी"
).split()
#: Those that go on before a number or a label with digits. Fixed values.
_BEFORE_NUMBER = "no nos nr qty p pp s ss ver v lot line item стр с п пп гл № т".split()
#: Those that go on before a Chinese, Japanese or Korean character without a space. Fixed values.
_BEFORE_CJK = "inc ltd co corp llc plc gmbh ag kg bros mfg int no nr etc e\\.g i\\.e".split()
_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mrz Apr Jun Jul Aug Sep Sept Okt Nov Dez".split()
#: German words after which a number with a full stop is an ordinal. Fixed values.
_BEFORE_ORDINAL = "der die das den dem des am im vom zum zur beim ab bis seit jeder jede jedes jedem jeden ein eine einer einen einem eines".split()
_NUMERALS = "一二三四五六七八九十"
_NUMBERED = rf"{_HS}*+[\p{{N}}{_NUMERALS}]{{1,3}}"
#: A list sign at the start of a line.
_SIGN = (
    rf"{_HS}*+(?:[（(]\p{{N}}{{1,3}}[）)]|\p{{N}}{{1,3}}[）)、]|\p{{N}}{{1,3}}[.．](?=[{_HSPACE}{_CJK}])|[①-⑳]|[-•·*●○■□◆▪‣]{_HS}"
    rf"|[{_NUMERALS}]{{1,3}}[、.．]|[（(][{_NUMERALS}]{{1,3}}[）)])"
)


def _any(words: list[str]) -> str:
    return "|".join(words)


def _paragraphs() -> list[tuple[str, str]]:
    """Empty lines; (pattern, replacement) in order, as everywhere below, all keeping the length."""
    return [(rf"\n(?={_HS}*+\n)", _PARA), (rf"({_PARA}{_HS}*+)\n", f"$1{_PARA}")]


def _addresses() -> list[tuple[str, str]]:
    """Question and exclamation marks in addresses, however long: all get a sign of their own, and those that go on are masked."""
    inside = rf"[^{_HSPACE}\n{_PARA}?!]*+"
    return [(rf"((?:https?|ftp)://{inside}|(?!^)\G{inside})[?!]", f"$1{_ASKED}"), (rf"{_ASKED}(?=[A-Za-z0-9/&=_%#])", _MASK), (_ASKED, "?")]


def _stops() -> list[tuple[str, str]]:
    """Full stops that end nothing, in one pass: the stop is consumed first and its surroundings are looked at only then."""
    word = r"(?<![\p{L}\p{M}\p{N}])"
    stop = r"[.．]"
    end_of_clause = rf"(?<=т\.{_WS}?[дпк]\.){_WS}+\p{{Lu}}"
    rules = [
        # In numbers, labels, versions, file names; before signs that go on.
        rf"(?=[\p{{L}}\p{{N}}\p{{M}}])(?![{_CJK}])(?<=[\p{{L}}\p{{N}}\p{{M}}]{stop})(?<![{_CJK}]{stop})",
        rf"(?=\p{{N}})(?<=(?:^|[{_HSPACE}\n{_PARA}(（≈~<>=±+-]){stop})",
        r"(?=[-/\\_@#&=+*^|])",
        r"(?<=[฀-๿]\.)",
        # Abbreviations.
        rf"(?<={word}(?i:{_any(_GOES_ON)})\.)",
        rf"(?={_WS}*(?:[\p{{N}}#№]|[A-Z]{{1,4}}-?\p{{N}}))(?<={word}(?i:{_any(_BEFORE_NUMBER)})\.)",
        rf"(?=[{_CJK}])(?<={word}(?i:{_any(_BEFORE_CJK)})\.)",
        # Initials and single letters, but not units behind a number.
        rf"(?={_WS}+\p{{Lu}})(?<=\p{{Lu}}\.)(?<![\p{{L}}\p{{N}}.'’-]\p{{Lu}}\.)(?<!\p{{N}}{_WS}\p{{Lu}}\.)",
        rf"(?<={word}z\.{_WS}?B\.)",
        rf"(?<=\p{{Ll}}\.)(?<![\p{{L}}\p{{M}}\p{{N}}.]\p{{Ll}}\.)(?<!\p{{N}}{_WS}\p{{Ll}}\.)(?!{end_of_clause})",
        # Ordinals.
        rf"(?={_WS}*(?:{_any(_MONTHS)})(?!\p{{L}}))(?<=(?<![\p{{N}}.,])\p{{N}}{{1,2}}\.)",
        rf"(?={_WS}+\p{{L}})(?<=\p{{N}}\.)(?<={word}(?i:{_any(_BEFORE_ORDINAL)}){_WS}\p{{N}}{{1,3}}\.)",
    ]
    return [(f"[.．…](?:(?={_MORE}*+[,;:，；：、])|(?<!…)(?!{_MORE})(?:{'|'.join(rules)}))", _MASK)]


def _items() -> list[tuple[str, str]]:
    """List items: a line with a list sign after another such line, or after a line that is complete; their numbers."""
    return [
        (rf"((?:\G|[\n{_PARA}]){_SIGN}[^\n{_PARA}]*+)\n(?={_SIGN})", f"$1{_ITEM}"),
        (rf"\n(?={_SIGN})(?<=[{_CJK}:：;；”’」』）)\]】》〉»\"{_MORE}{_MARKS}]\r?\n)", _ITEM),
        (rf"([{_PARA}{_ITEM}]{_NUMBERED})[.．)）](?!\p{{N}})", f"$1{_MASK}"),
    ]


def _ends() -> list[tuple[str, str]]:
    """The number of a list sign at the start of the text, dots before a small letter."""
    return [
        (rf"(^{_NUMBERED})[.．)）](?!\p{{N}})", f"$1{_MASK}"),
        (rf"[.…](?={_MORE}*+{_WS}*+\p{{Ll}})(?<=…|\.(?={_MORE}|{_WS}))", _MASK),
    ]


#: An end mark behind another is part of its run.
_RUN = (rf"{_END}(?<=[{_MORE}{_END}]{_END})", _MORE)


#: Private-use characters of the text itself; a dot behind another.
_PRIVATE, _DOTS = ("[\ue000-\ue0ff]", "\ufffd"), (r"[.．…](?<=[.．…][.．…])", _MORE)


def _steps() -> list[tuple[str, str]]:
    """All steps up to the pairs of quotes and brackets, in order."""
    return [_PRIVATE, *_paragraphs(), *_addresses(), _DOTS, *_stops(), *_items(), *_ends(), (f"[{_MARKS}]", _END)]


def _pair_steps() -> list[tuple[str, str, str]]:
    """(opening signs, pattern, replacement) that give each kind of pair its own private signs, in order."""
    pairs = [*((p[0], p[1:]) for p in _PAIRS), ("（(", "）)"), ("（(", "）)")]
    out = []
    for i, (o, c) in enumerate(pairs):
        both = (o + c).replace("[", r"\[").replace("]", r"\]")
        out.append((o, rf"[{o.replace('[', chr(92) + '[')}]([^{both}{_PARA}{_ITEM}]*)[{c.replace(']', chr(92) + ']')}]", f"{_OPEN[i]}$1{_CLOSE[i]}"))
    return out


def _inside() -> list[tuple[str, str, str]]:
    """(opening, closing, pattern of the marks between them to mask): all in titles, else all but those at the end."""
    kinds = [*_PAIRS, "()", "()"]
    return [(o, c, _END if kind in _TITLES else rf"{_END}(?!{_MORE}*+{_WS}*+[{_CLOSERS}]*+$)") for o, c, kind in zip(_OPEN, _CLOSE, kinds)]


#: White space of all kinds, and the signs that stand for line breaks while a text is masked.
_BLANK = f"[{_HSPACE}\n{_PARA}{_ITEM}]"
_BLANKS = "".join(c for c in map(chr, range(0xE003)) if c in f"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85{_PARA}{_ITEM}" or unicodedata.category(c) in ("Zs", "Zl", "Zp"))
#: A mark at the end of quotes or brackets after which the surrounding sentence goes on.
_GOING_ON = (rf"{_END}(?={_MORE}*+[{_CLOSERS}]++(?:{_WS}*+[,，、;；:：—–―-]|{_WS}*+\p{{Ll}}|{_END}|[のとではがをにもかやへっ가-힣的地得之等了吗呢吧啊]))", _MASK)
#: An empty line or a line break before an item with the space around it, between separators.
_BREAK = (rf"(?={_BLANK})(?<!{_WS})({_WS}*+[{_PARA}{_ITEM}]{_BLANK}*+)", f"{_SEP}$1{_SEP}")
_THAI = "[ก-ฺเ-๎]"
#: The space behind an end mark and what closes there, and the space between Thai letters, between separators.
_SPACE = (rf"({_END}{_MORE}*+[{_CLOSERS}”’」』）)\]】》〉»]*+)({_BLANK}*+)|({_THAI})({_WS}++)(?={_THAI})", f"$1$3{_SEP}$2$4{_SEP}")


def _separators() -> list[tuple[str, str]]:
    """The steps behind the pairs, in order; they mask the last marks and set the separators."""
    return [_GOING_ON, _BREAK, _SPACE]


#: Pieces that are cut off at a time, from large to small and even, so that adding up what lies before a piece never takes long, however many there are.
_SLICES = (2048, 32)


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, *step), steps, text)


def _mask_inside(opening: str, closing: str, all_marks: bool) -> tuple[str, str]:
    """The step that masks the marks inside one kind of pairs, from each to the next; pairs of one kind never nest, so this is linear."""
    before = f"[^{closing}{_END}]*+"
    last = "" if all_marks else rf"(?!{_MORE}*+{_WS}*+[{_CLOSERS.replace(closing, '')}]*+\n?{closing})"
    return rf"({opening}{before}|(?!^)\G{before}){_END}{last}", f"$1{_MASK}"


def _barrier(rows: DataFrame, doc_id: str, t: Column, *more: str | Column) -> DataFrame:
    """(doc_id, t, ...); the explode of a one-element array keeps t from being written out once per use, so it is computed once per text."""
    return rows.select(F.col(doc_id), F.explode(F.array(t)).alias("t"), *more)


def _where(*signs: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains("t", F.lit(o)) for o in signs])


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda acc, n: acc + n)


def _sliced(rows: DataFrame, doc_id: str, size: int) -> DataFrame:
    """(doc_id, p, at): the lengths p, which begin at ``at``, in slices of ``size``, each with its own begin."""
    many = F.size("p") > size
    sums = F.when(many, F.transform(F.sequence(F.lit(0), ((F.size("p") - 1) / size).cast("int")), lambda i: _total(F.slice("p", i * size + 1, size)))).otherwise(F.array(F.lit(0)))
    rows = rows.select(F.col(doc_id), "p", "at", F.explode(F.array(sums)).alias("sums"))
    whole = F.array(F.struct("p", "at"))
    parts = F.transform("sums", lambda _, i: F.struct(F.slice("p", i * size + 1, size).alias("p"), (F.col("at") + _total(F.slice("sums", 1, i))).alias("at")))
    return rows.select(F.col(doc_id), F.explode(F.when(F.size("sums") > 1, parts).otherwise(whole)).alias("c")).select(F.col(doc_id), "c.p", "c.at")


def masked(texts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, t): the texts, none null, with every end mark that ends nothing masked."""
    t = F.col("t")
    # Private-use characters start with the byte EE, as no others do.
    private = F.contains(F.col(text).cast("binary"), F.lit(b"\xee"))
    rows = _barrier(texts, doc_id, F.when(private, F.regexp_replace(text, *_PRIVATE)).otherwise(F.col(text)))
    for signs, steps in ((("\n",), _paragraphs()), (("://",), _addresses()), (("..", "…", "．"), [_DOTS])):
        rows = _barrier(rows, doc_id, F.when(_where(*signs), _replaced(t, steps)).otherwise(t))
    rows = _barrier(rows, doc_id, _replaced(t, _stops()))
    rows = _barrier(rows, doc_id, F.when(_where("\n", _PARA), _replaced(t, _items())).otherwise(t))
    # All other marks become one sign.
    rows = _barrier(rows, doc_id, F.regexp_replace(F.translate(_replaced(t, _ends()), _MARKS, _END * len(_MARKS)), *_RUN))
    pairs, inside = _pair_steps(), [_mask_inside(o, c, m == _END) for o, c, m in _inside()]
    # Whether a text holds the first bytes of any sign of some kinds, so that most kinds need not be searched for one by one.
    starts = sorted({start for _, start in _TOGETHER} - {b""})
    flags = [f"has_{start.hex()}" for start in starts]
    has = lambda start: F.contains(F.col("t").cast("binary"), F.lit(start))
    rows = rows.select(F.col(doc_id), "t", *[has(start).alias(f) for start, f in zip(starts, flags)])
    for kinds, start in _TOGETHER:
        signs = _where(*dict.fromkeys("".join(pairs[k][0] for k in kinds)))
        rows = _barrier(rows, doc_id, F.when(F.col(f"has_{start.hex()}") & signs if start else signs, _replaced(t, [pairs[k][1:] for k in kinds])).otherwise(t), *flags)
    rows = rows.select(F.col(doc_id), "t", *flags, has(b"\xee\x81").alias("paired"))
    for kinds, start in _TOGETHER:
        signs = F.col("paired") & _where(*[_CLOSE[k] for k in kinds])
        rows = _barrier(rows, doc_id, F.when(F.col(f"has_{start.hex()}") & signs if start else signs, _replaced(t, [inside[k] for k in kinds])).otherwise(t), *flags, "paired")
    return _barrier(rows, doc_id, F.when(F.col("paired"), F.regexp_replace("t", *_GOING_ON)).otherwise(t))


def sentence_spans(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentence: str | None = None) -> DataFrame:
    """(doc_id, sent_start, sent_end): 0-based code-point offsets of the first character and behind the last.

    White space around a sentence is left out; null, empty and white-space texts have none. One
    set of spans per row; a repeated row gives repeated spans. Texts are split whole, however
    long; other columns are not read. Private-use characters U+E000 to U+E0FF of a text count as
    letters without a meaning. With ``sentence`` a column of that name holds the sentence itself.
    """
    if sentence is not None:
        found = sentence_spans(documents.select(F.struct(doc_id, text).alias("d"), F.col(text).alias("text")), doc_id="d")
        cut = F.substring(F.col("d")[text], F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start"))
        return found.select(F.col("d")[doc_id].alias(doc_id), "sent_start", "sent_end", cut.alias(sentence))
    blanks = F.lit(_BLANKS)
    rows = masked(spread(documents.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text))), doc_id, text)
    # Sentences and the spaces between them by turns; what surrounds the whole text is left out first.
    rows = rows.select(F.col(doc_id), "t", F.ltrim("t", blanks).alias("right")).where("right <> ''")
    rows = _barrier(rows, doc_id, F.rtrim("right", blanks), (F.length("t") - F.length("right")).alias("lead"))
    broken = F.when(_where(_PARA, _ITEM), F.regexp_replace("t", *_BREAK)).otherwise(F.col("t"))
    pieces = F.split(F.regexp_replace(broken, *_SPACE), _SEP)
    rows = rows.select(F.col(doc_id), F.explode(F.array(F.transform(pieces, F.length))).alias("p"), F.col("lead").alias("at"))
    for size in _SLICES:
        rows = _sliced(rows, doc_id, size)
    # The even ones are sentences.
    each = F.transform(F.sequence(F.lit(0), F.size("p") - 1, F.lit(2)), lambda i: F.struct((F.col("at") + _total(F.slice("p", 1, i))).alias("at"), F.element_at("p", i + 1).alias("n")))
    spans = rows.select(F.col(doc_id), F.explode(each).alias("s")).where("s.n > 0")
    return spans.select(F.col(doc_id), F.col("s.at").alias("sent_start"), (F.col("s.at") + F.col("s.n")).alias("sent_end"))
