"""Quantities in text: numbers, unit expressions, dimensions.

A unit is a scale and an offset to the canonical unit of its dimension, and the dimension is a
vector of exponents over ``DIMENSIONS``. Unit expressions follow the grammar

    expression := term (("/" | "per" | "·" | "*") term)*
    term       := [number] [multiple] atom [exponent]

so ``W/m·K``, ``100 pcs``, ``千只`` and ``mm²`` are all read by one parser. A price basis is such
an expression too; a container (box, reel ...) in it is replaced by the content that the
description gives for it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

DIMENSIONS = ("piece", "metre", "kilogram", "second", "ampere", "kelvin")
_ZERO = (0,) * len(DIMENSIONS)


def _dim(**e: int) -> tuple[int, ...]:
    return tuple(e.get(d, 0) for d in DIMENSIONS)


@dataclass(frozen=True)
class Unit:
    scale: float
    dim: tuple[int, ...]
    offset: float = 0.0

    def __mul__(self, o: Unit) -> Unit:
        return Unit(self.scale * o.scale, tuple(a + b for a, b in zip(self.dim, o.dim)))

    def __pow__(self, n: int) -> Unit:
        return self if n == 1 else Unit(self.scale**n, tuple(a * n for a in self.dim))

    def to_canonical(self, value: float) -> float:
        return value * self.scale + self.offset


PIECE = Unit(1.0, _dim(piece=1))
_ENERGY = _dim(kilogram=1, metre=2, second=-2)
_POWER = _dim(kilogram=1, metre=2, second=-3)
_VOLT = _dim(kilogram=1, metre=2, second=-3, ampere=-1)

#: Spellings of each unit, in lower case after compatibility normalisation. Fixed values.
_SPELLINGS: list[tuple[str, Unit]] = [
    ("pcs pc pce pieces piece ea each unit units st stk stück 个 個 只 隻 片 件 颗 顆 支 根 把 条 條 枚 块 塊 张 張 套 台 粒 副 set sets nos no.", PIECE),
    ("pair pairs 对 双", Unit(2, PIECE.dim)),
    ("dozen dozens doz dz dzn 打", Unit(12, PIECE.dim)),
    ("gross 罗", Unit(144, PIECE.dim)),
    ("hundred hundreds", Unit(100, PIECE.dim)),
    ("thousand thousands mille kpcs kpc", Unit(1000, PIECE.dim)),
    ("m mtr mtrs metre metres meter meters 米 公尺", Unit(1, _dim(metre=1))),
    ("dm 分米", Unit(0.1, _dim(metre=1))),
    ("cm 厘米 公分 centimetre centimeter", Unit(0.01, _dim(metre=1))),
    ("mm 毫米 millimetre millimeter", Unit(0.001, _dim(metre=1))),
    ("km 公里 千米 kilometre kilometer", Unit(1000, _dim(metre=1))),
    ("ft foot feet 英尺 呎", Unit(0.3048, _dim(metre=1))),
    ("in inch inches 英寸 吋", Unit(0.0254, _dim(metre=1))),
    ("yd yard yards 码", Unit(0.9144, _dim(metre=1))),
    ("kg kgs kilo kilogram kilograms 千克 公斤", Unit(1, _dim(kilogram=1))),
    ("g gr gram grams 克", Unit(0.001, _dim(kilogram=1))),
    ("mg 毫克", Unit(1e-6, _dim(kilogram=1))),
    ("t mt ton tons tonne tonnes 吨 公吨", Unit(1000, _dim(kilogram=1))),
    ("lb lbs pound pounds 磅", Unit(0.45359237, _dim(kilogram=1))),
    ("oz ounce ounces 盎司", Unit(0.028349523125, _dim(kilogram=1))),
    ("jin catty 斤 市斤", Unit(0.5, _dim(kilogram=1))),
    ("liang 两 市两", Unit(0.05, _dim(kilogram=1))),
    ("l liter litre 升", Unit(0.001, _dim(metre=3))),
    ("ml 毫升", Unit(1e-6, _dim(metre=3))),
    ("s sec 秒", Unit(1, _dim(second=1))),
    ("min 分钟", Unit(60, _dim(second=1))),
    ("h hr hour 小时", Unit(3600, _dim(second=1))),
    ("a amp 安", Unit(1, _dim(ampere=1))),
    ("ma 毫安", Unit(0.001, _dim(ampere=1))),
    ("ka 千安", Unit(1000, _dim(ampere=1))),
    ("v volt 伏", Unit(1, _VOLT)),
    ("kv 千伏", Unit(1000, _VOLT)),
    ("va", Unit(1, _POWER)),
    ("w watt 瓦", Unit(1, _POWER)),
    ("kw 千瓦", Unit(1000, _POWER)),
    ("j", Unit(1, _ENERGY)),
    ("k", Unit(1, _dim(kelvin=1))),
    ("°c ℃", Unit(1, _dim(kelvin=1), 273.15)),
    ("°f", Unit(5 / 9, _dim(kelvin=1), 459.67 * 5 / 9)),
]
UNITS = {word: unit for words, unit in _SPELLINGS for word in words.split()}
#: Chinese multiples in front of a unit. Fixed values.
_MULTIPLES = {"十": 10, "百": 100, "千": 1000, "万": 10000}
#: Words for containers, with the others that mean the same. Fixed values.
_CONTAINER_WORDS = ("箱 carton cartons ctn case", "盒 box boxes bx", "袋 bag bags", "包 pack packs pkt packet", "卷 roll rolls", "盘 reel reels 圈 轴", "桶 drum drums barrel", "罐 can cans tin", "瓶 bottle", "捆 扎 bundle", "托 pallet", "管 tube")
CONTAINERS = {word: words.split()[0] for words in _CONTAINER_WORDS for word in words.split()}

_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_ATOMS = "|".join(sorted(map(re.escape, [*UNITS, *CONTAINERS]), key=lambda w: (-len(w), w)))
#: Where a word ends: a Latin one before anything but a Latin letter, any other one at once.
_END = "(?:(?<![a-zà-ÿ])|(?![a-zà-ÿ]))"
#: A word that itself begins with a multiple's sign (千克) is tried before a multiple and a word (千只).
_TERM = re.compile(rf"\s*(?P<n>{_NUMBER})?\s*(?:(?P<atom>{_ATOMS})|(?P<mult>[十百千万])\s*(?P<of>{_ATOMS})){_END}(?P<exp>[²³]|\^-?\d|[23](?!\d))?\.?")
_OPERATOR = re.compile(r"\s*(/|·|\*|⋅|per\b)\s*")
_EXPONENTS = {"²": 2, "³": 3}


def _kept_case(text: str) -> str:
    """Compatibility form without invisible characters; superscripts stay."""
    if not text.isascii():
        kept = text.replace("²", "\ue002").replace("³", "\ue003")
        if not unicodedata.is_normalized("NFKC", kept):
            kept = unicodedata.normalize("NFKC", kept)
        if not kept.isprintable():  # no invisible character is printable
            kept = "".join(c for c in kept if unicodedata.category(c) != "Cf")
        text = kept.replace("\ue002", "²").replace("\ue003", "³")
    return " ".join(text.split())


def plain(text: str | None) -> str:
    """Compatibility form without invisible characters, in lower case; superscripts stay."""
    return _kept_case(text).lower() if text else ""


def plain_description(text: str | None) -> str:
    """``plain``, with a space where a capital follows a small letter: ``bagA`` is a bag and an A, ``baga`` is one word."""
    return re.sub(r"(?<=[a-zß-ÿ])(?=[A-Z])", " ", _kept_case(text)).lower() if text else ""


def _term(text: str, at: int, contents: dict[str, tuple[float, str]] | None, inside: frozenset[str] = frozenset()):
    """The unit of the term at ``at`` and where it ends, or None. ``inside``: the containers whose content is being read."""
    m = _TERM.match(text, at)
    if m is None:
        return None
    atom = m["atom"] or m["of"]
    unit = UNITS.get(atom)
    if unit is None:  # a container
        container = CONTAINERS[atom]
        content = (contents or {}).get(container) if container not in inside else None  # a circle has no content
        inner = _term(content[1], 0, contents, inside | {container}) if content else None
        if inner is None:
            return None
        unit = Unit(inner[0].scale * content[0], inner[0].dim)
    if m["exp"]:
        unit = unit ** (_EXPONENTS.get(m["exp"]) or int(m["exp"].lstrip("^")))
    factor = float((m["n"] or "1").replace(",", "")) * _MULTIPLES.get(m["mult"], 1)
    return (unit if factor == 1 else Unit(unit.scale * factor, unit.dim, unit.offset)), m.end()


def parse_unit(text: str, contents: dict[str, tuple[float, str]] | None = None, whole: bool = True) -> Unit | None:
    """The unit that ``text`` names, or None. ``contents``: container -> (quantity, unit word)."""
    got = _term(text, 0, contents)
    if got is None:
        return None
    (unit, at), power = got, 1
    while m := _OPERATOR.match(text, at):
        nxt = _term(text, m.end(), contents)
        if nxt is None:
            break
        # What is joined by a dot stays below the line: W/m·K is W/(m·K).
        power = -1 if m[1] in ("/", "per") else power
        unit, at = unit * (Unit(nxt[0].scale**power, tuple(e * power for e in nxt[0].dim))), nxt[1]
    return unit if not whole or not text[at:].strip(" .") else None


def _words(names) -> str:
    return "|".join(sorted(map(re.escape, names), key=lambda w: (-len(w), w)))


_C, _U = _words(CONTAINERS), _words(w for w, u in UNITS.items() if sum(map(abs, u.dim)) == 1 and u.dim[3:] == (0, 0, 0))
_QTY = rf"(?<![\d.])(?:(?<![^\s(（:：;；【\[=每])(?P<q{{0}}>\d{{{{1,3}}}}(?:,\d{{{{3}}}})+(?:\.\d+)?)|(?P<p{{0}}>\d+(?:\.\d+)?))"
#: Contents of a container: "50只/盒", "50只一盒", "每盒50只", "1盒=50只", "50 pcs per box", "box of 50 pcs".
_CONTENT = [
    re.compile(_QTY.format(0) + rf"\s*(?P<u0>{_U})\.?\s*(?:/|一|per\s+)\s*(?P<c0>{_C}){_END}"),
    re.compile(rf"(?:每|(?<![\d.])1\s*)(?P<c1>{_C})\s*(?:[=:装含]\s*)?" + _QTY.format(1) + rf"\s*(?P<u1>{_U}|{_C}){_END}"),
    re.compile(rf"(?P<c2>{_C})\s+of\s+" + _QTY.format(2) + rf"\s*(?P<u2>{_U}){_END}"),
    re.compile(_QTY.format(3) + rf"\s*(?P<u3>{_C})\s*(?:/|一|per\s+)\s*(?P<c3>{_C}){_END}"),
]
_N = rf"(?:(?:{_NUMBER})\s*)?[十百千万]?\s*(?:{_words([*UNITS, *CONTAINERS])}){_END}"
#: Where a description states what the price is for. Fixed values.
_BASIS = [
    re.compile(rf"(?:计价单位|价格单位|报价单位|单价单位)\s*(?:[:为是]\s*)?(?P<x>{_N})"),
    re.compile(rf"以\s*(?:每\s*)?(?P<x>{_N})\s*为\s*(?:价格|计价|报价)单位"),
    re.compile(rf"(?:单价|价格|报价)\s*(?:为|按|是|:)?\s*(?:每|/)\s*(?P<x>{_N})"),
    re.compile(rf"按\s*(?:每\s*)?(?P<x>{_N})\s*(?:报价|计价|定价)"),
    re.compile(rf"(?:元|¥|rmb|cny|usd|eur|\$|€)\s*(?:/|每|per\s+)\s*(?P<x>{_N})"),
    re.compile(rf"每\s*(?P<x>{_N})\s*(?:的)?(?:单价|价格?)"),
    re.compile(rf"(?:unit\s+)?price\s+(?:is\s+)?(?:for|per|/)\s*(?:an?\s+|each\s+|every\s+)?(?P<x>{_N})"),
    re.compile(rf"(?:price\s*/|pricing\s+unit\s*:?|price\s+unit\s*:?|price\s+basis\s*:?)\s*(?P<x>{_N})"),
    re.compile(rf"(?:quoted|priced|sold|charged)\s+(?:per|by|by\s+the|in)\s+(?:an?\s+|each\s+)?(?P<x>{_N})"),
]


def contents_of(desc: str) -> dict[str, tuple[float, str]]:
    """Container -> (quantity, unit word) as the (plain) description states; the first statement of a container counts."""
    found: dict[str, tuple[float, str]] = {}
    for i, pattern in enumerate(_CONTENT):
        for m in pattern.finditer(desc):
            q = float((m[f"q{i}"] or m[f"p{i}"]).replace(",", ""))
            if q > 0 and CONTAINERS[m[f"c{i}"]] != CONTAINERS.get(m[f"u{i}"]):
                found.setdefault(CONTAINERS[m[f"c{i}"]], (q, m[f"u{i}"]))
    return found


class _AnyContainer(dict):
    """Contents with the only stated one standing for every container not named."""

    def get(self, key, default=None):
        return super().get(key) or (next(iter(self.values())) if len(self) == 1 else default)


#: Signs of a statement that the patterns above look for: a content needs a number, a basis a word or sign of price.
_HAS_CONTENT = re.compile(r"\d")
_HAS_BASIS = re.compile(r"[价元¥$€]|rmb|cny|usd|eur|pric|quoted|sold|charged")


@lru_cache(maxsize=200_000)
def _stated(desc: str | None) -> tuple[str | None, dict[str, tuple[float, str]]]:
    """(the price basis that a description states, contents of containers)."""
    d = plain_description(desc)
    contents = _AnyContainer(contents_of(d)) if _HAS_CONTENT.search(d) else {}
    stated = [(m.start(), m["x"]) for p in _BASIS if (m := p.search(d))] if _HAS_BASIS.search(d) else []
    return (min(stated)[1] if stated else None), contents


def price_basis(unit: str | None, desc: str | None) -> tuple[float, tuple[int, ...]] | None:
    """(canonical units that one price covers, dimension), or None where that cannot be known.

    A basis stated in the description holds over the unit; a mere content or dimension there is
    none. A container counts as its stated content, however deeply nested; without one, or where
    contents name each other in a circle, the basis is unknown.
    """
    basis, contents = _stated(desc)
    text = _plain_unit(unit) if basis is None else basis
    return _common(parse_unit(text, contents)) if contents else _basis_without_content(text)


_plain_unit = lru_cache(maxsize=20_000)(plain)


@lru_cache(maxsize=20_000)
def _basis_without_content(text: str) -> tuple[float, tuple[int, ...]] | None:
    return _common(parse_unit(text))


def _common(got: Unit | None) -> tuple[float, tuple[int, ...]] | None:
    if got is None or not got.scale > 0 or sum(got.dim) != 1 or sum(map(abs, got.dim)) != 1 or any(got.dim[3:]):
        return None
    return got.scale, got.dim
