"""Pack specifications in names and descriptions, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that are counted, containers they come in, and spellings of the piece. Fixed values.
ITEMS, CONTAINERS = "根个只支条片米卷对套双颗粒块张件枚把芯节组列册本张盘圈管", "包袋盒卷桶箱板排捆扎盘圈管罐瓶束"
_UNIT = rf"(?:PCS|pcs|Pcs|pc|[{ITEMS}])"
_N = r"(\d+(?:\.\d+)?)"
#: (pattern, group of the quantity, group of the container): 250根/包, 1000个一包, 每包1000个.
PATTERNS = ((rf"{_N}\s*{_UNIT}\s*/\s*([{CONTAINERS}])", 1, 2), (rf"{_N}\s*{_UNIT}\s*一\s*([{CONTAINERS}])", 1, 2), (rf"每\s*([{CONTAINERS}])\s*{_N}\s*{_UNIT}?", 2, 1))
#: A container without a quantity.
BARE = rf"(?:/\s*|每)([{CONTAINERS}])"
WIDE, NARROW = "０１２３４５６７８９．／ＰＣＳｐｃｓ\u00a0\u3000", "0123456789./PCSpcs  "


def pack_spec(description: Column, name: Column) -> Column:
    """struct(qty, container, source, confidence): what one container holds, or null.

    The description is read before the name, and all patterns in one text before the next text. A
    quantity below 2 is none. Where only a container is named, its quantity is null and the
    confidence low; of several the first in the order of ``CONTAINERS`` counts. Null texts are empty.
    """
    texts = [(source, F.translate(F.coalesce(c, F.lit("")), WIDE, NARROW)) for source, c in (("desc", description), ("name", name))]

    def spec(qty: Column, container: Column, source: str, confidence: str) -> Column:
        return F.struct(qty.cast("double").alias("qty"), container.alias("container"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    found = []
    for source, text in texts:
        for pattern, q, c in PATTERNS:
            qty = F.regexp_extract(text, pattern, q).try_cast("double")
            found.append(F.when(qty >= 2, spec(qty, F.regexp_extract(text, pattern, c), source, "high")))
    for source, text in texts:
        places = F.transform(F.regexp_extract_all(text, F.lit(BARE), F.lit(1)), lambda x: F.instr(F.lit(CONTAINERS), x))
        at = F.array_min(places)
        found.append(F.when(at.isNotNull(), spec(F.lit(None), F.substring(F.lit(CONTAINERS), at, F.lit(1)), source, "low")))
    return F.coalesce(*found)
