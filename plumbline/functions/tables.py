"""Tables pasted as text: rows split, headers recognised, cells assigned to fields.

State runs from the header to the rows below it, so a text is parsed as a whole by a table
function in Python; everything after that is columns again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Header words of each field, after removal of spaces and brackets. Fixed values.
QUOTE_FIELDS = {
    "name": ("名称", "品名", "物料名称", "产品名称", "项目名称", "分项名称", "材料名称", "设备名称", "货物名称", "项目", "分项", "name", "item"),
    "unit": ("单位", "计量单位", "unit"),
    "qty": ("数量", "工程量", "qty", "quantity"),
    "price": ("单价", "综合单价", "含税单价", "price", "unitprice"),
    "amount": ("金额", "合价", "总价", "合计", "小计", "amount", "total"),
}
#: Words that may stand as a unit between name and numbers. Fixed values.
UNIT_WORDS = frozenset(
    "t T kg KG g 吨 公斤 千克 m M m2 m3 ㎡ m³ 米 延米 平方米 立方米 km 公里 项 个 台 套 组 批 樘 处 座 孔 根 块 片 张 条 只 付 对 户 人 工日 台班 月 年 次 站 系统 "
    "pcs PCS pc EA ea set 件 支 把 枚 颗 箱 盒 包 袋 卷 盘 桶 瓶 罐".split()
)
_NUMBER = re.compile(r"^[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$")
#: Lines that are no rows, by how they begin. Fixed values.
_NOISE = re.compile(r"^(?:$|[-=—_·\s|+]+$|序号|合计|小计|总计|备注|说明|注[:：]|以下空白)")


def split_row(line: str, at_least: int = 2) -> list[str]:
    """Cells by pipe, tab, comma (not between thousands), two or more spaces, or single spaces, whichever comes first.

    Commas and wide spaces count only if they give ``at_least`` cells. Empty cells between pipes or
    tabs stay, those at the ends and between other separators do not.
    """
    if "|" in line or "\t" in line:
        sep = "|" if "|" in line else "\t"
        cells = [c.strip() for c in line.split(sep)]
        while cells and not cells[0] and sep == "|":
            cells.pop(0)
        while cells and not cells[-1]:
            cells.pop()
        return cells
    for pattern in (r",(?!\d{3}(?:\D|$))|，", r"\s{2,}"):
        cells = [c.strip() for c in re.split(pattern, line.strip()) if c.strip()]
        if len(cells) >= at_least:
            return cells
    return line.split()


def header_of(cells: list[str], fields: dict[str, tuple[str, ...]] = QUOTE_FIELDS) -> dict[str, int] | None:
    """Field -> column of a header row; it must name quantity and price, or price and amount."""
    at = {}
    for i, cell in enumerate(cells):
        word = re.sub(r"[(（\[].*?[)）\]]|\s", "", cell).lower()
        for field, words in fields.items():
            if word in words and field not in at:
                at[field] = i
    return at if "price" in at and ("qty" in at or "amount" in at) else None


def number(cell: str | None) -> float | None:
    cell = (cell or "").strip()
    return float(cell.replace(",", "")) if _NUMBER.match(cell) else None


def tail_numbers(cells: list[str]) -> dict | None:
    """A row without header: the two or three numbers at its end are quantity, price and amount; of four and more nobody knows which is which."""
    at = len(cells)
    while at and number(cells[at - 1]) is not None:
        at -= 1
    rest, numbers = cells[:at], [number(c) for c in cells[at:]]
    if not 2 <= len(numbers) <= 3 or len(cells) < 3:
        return None
    if len(rest) > 1 and re.fullmatch(r"\d{1,3}[.、]?", rest[0]):
        rest = rest[1:]
    unit = rest.pop() if len(rest) > 1 and rest[-1] in UNIT_WORDS else None
    return {"name": " ".join(rest), "unit": unit, "qty": numbers[0], "price": numbers[1], "amount": numbers[2] if len(numbers) == 3 else None} if rest else None


def parse_table(text: str | None) -> Iterator[tuple]:
    """(line, name, unit, qty, price, amount) of each row that has a name and a number; lines count from 1."""
    header = None
    for i, line in enumerate((text or "").splitlines(), 1):
        cells = split_row(line, at_least=3)
        if len(cells) < 2:
            continue
        found = header_of(cells)
        if found:
            header = found
            continue
        if _NOISE.match(line.strip()):
            continue
        if header:
            cell = lambda f: cells[header[f]] if f in header and header[f] < len(cells) else None  # noqa: B023, E731
            row = {"name": cell("name"), "unit": cell("unit"), **{f: number(cell(f)) for f in ("qty", "price", "amount")}}
        else:
            row = tail_numbers(cells)
        if row and row["name"] and any(row[f] is not None for f in ("qty", "price", "amount")):
            yield (i, row["name"], row["unit"], row["qty"], row["price"], row["amount"])


#: Patterns of the columns of a stock count, tried in order; the first that occurs in a header cell decides. Fixed values.
STOCK_ROLES = (
    ("code", r"编码|代码|料号|code"), ("name", r"名称|品名|name"), ("opening", r"期初|opening"), ("in_amount", r"入库金额"), ("in_qty", r"入库|inbound"), ("out_qty", r"出库|outbound"), ("diff_amount", r"(差异|盈亏)金额"),
    ("book_qty", r"账面|book"), ("actual_qty", r"实盘|实存|actual"), ("diff_qty", r"差异|盈亏|diff"), ("price", r"单价|price"),
)
STOCK_NUMBERS = ("opening", "in_qty", "out_qty", "book_qty", "actual_qty", "diff_qty", "price", "in_amount", "diff_amount")


#: Words of columns that hold no quantity or amount, whatever else their header says. Fixed values.
_NO_ROLE = re.compile(r"备注|状态|日期|月份|仓库|库位|经办|盘点人|类别")


def role_of(cell: str) -> str | None:
    cell = re.sub(r"\s", "", cell)
    if _NO_ROLE.search(cell):
        return None
    return next((role for role, pattern in STOCK_ROLES if re.search(pattern, cell, re.I)), None)


def amount(cell: str | None) -> float | None:
    """A whole cell as number: currency signs, commas and 元 dropped, (x) is -x."""
    c = re.sub(r"[¥￥,元\s]", "", cell or "")
    c = re.sub(r"^\((.*)\)$", r"-\1", c)
    return float(c) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)", c) else None


def parse_stock(text: str | None) -> Iterator[tuple]:
    """(line, is_total, code, name, numbers...) of a stock count; the header is among the first ten lines, cells are split by tab, comma or white space."""
    header = None
    for i, line in enumerate((text or "").splitlines(), 1):
        cells = [c.strip() for c in re.split("\t" if "\t" in line else "[,，]" if re.search("[,，]", line) else r"\s+", line.strip())] if line.strip() else []
        if header is None:
            roles = [role_of(c) for c in cells]
            if i <= 10 and len({r for r in roles if r}) >= 3:
                header = {r: k for k, r in reversed(list(enumerate(roles))) if r}
            continue
        if not cells:
            continue
        cell = lambda role: cells[header[role]] if role in header and header[role] < len(cells) else None  # noqa: B023, E731
        total = any(re.fullmatch(r"合计|总计|小计|total", c, re.I) for c in cells[:2])
        yield (i, total, cell("code"), cell("name"), *(amount(cell(r)) for r in STOCK_NUMBERS))


STOCK_ROW = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("is_total", T.BooleanType()), T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), *(T.StructField(r, T.DoubleType()) for r in STOCK_NUMBERS)])


@udtf(returnType=STOCK_ROW)
class StockRows:
    """Lateral table function over ``parse_stock``."""

    def eval(self, text: str):
        yield from parse_stock(text)


TABLE_ROW = T.StructType(
    [T.StructField("line", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("unit", T.StringType()), *(T.StructField(f, T.DoubleType()) for f in ("qty", "price", "amount"))]
)


@udtf(returnType=TABLE_ROW)
class TableRows:
    """Lateral table function over ``parse_table``."""

    def eval(self, text: str):
        yield from parse_table(text)
