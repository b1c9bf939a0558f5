"""Catalog of the business entities that can be scanned, and checks of filters before any read.

An entity is a landed table ``<module>_<name>``; its filter keys are those declared for it
(``declare``), else the columns of that table with ``from_``, ``to_`` and plural forms. An entity
that is still behind a service is scanned by ``scan_service``, in the way its kind demands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.paged import envelope, scan_pages, whole

#: Entities by module and kind of scan. Fixed values.
_NAMES = {
    "md": {
        "paged": "currency material plant measure_unit account account_contact sales_organization",
        "bare": "company_code material_category exchange_rate",
        "tree": "product_level",
    },
    "mm": {
        "paged": "supplier purchase_order info_record contract purchase_requirement source_list ecn",
        "post": "rfq quotation",
        "bare": "bom currency",
    },
    "wm": {
        "paged": "storage_location storage_bin unit requisition material_doc trans_order warehouse_request inventory_check_task mo check_order sales_order_shipment stock",
        "post": "available_stock assembly_order",
        "bare": "move_type rd_category warehouse wm_config",
        "lookup": "delivery_order",
    },
    "sd": {
        "paged": "sales_order_item delivery_group_no sd_info_record delivery_receipt_type delivery_receipt contract_item sales_order contract",
        "post": "quotation",
        "bare": "sales_dept contract_category so_item_category delivery_receipt_item",
    },
    "pp": {
        "paged": "kitting_template production_plan_record",
        "body": "demand_supply sales_order production_plan",
        "bare": "mrp_history mrp_rule",
        "tree": "bom_tree",
    },
    "qm": {"paged": "rule_group check_sheet reject_order inspection_lot inspection_order"},
    "cr": {"paged": "opp", "post": "service_order fee", "bare": "service_person fee_category work_log_category"},
    "fn": {"paged": "payment_receipt_order", "bare": "company_code posting_period", "twin": "payment_receipt fapiao"},
}
#: Arguments without which a scan is refused. Fixed values.
_REQUIRED = {
    "md.exchange_rate": ("exchange_rate_type", "from_currency_code", "to_currency_code"),
    "mm.bom": ("material_id",),
    "sd.delivery_receipt": ("company_id",),
    "wm.delivery_order": ("delivery_order_name", "ref_order_id"),
    "pp.production_plan_record": ("production_plan_id",),
    "fn.payment_receipt": ("from_posting_period_id", "to_posting_period_id"),
}
#: Modules of the entities that have two. Fixed values.
_TWINS = ("ar", "ap")
#: Patterns of extension columns that are filter keys besides the table's own. Fixed values.
_EXTENSIONS = {"md.material": r"field_[a-z]{1,2}", "sd.sales_order_item": r"column_[a-z]"}
#: Pairs of arguments that exclude each other. Fixed values.
_EXCLUSIVE = {"wm.stock": ("material_id", "material_ids")}


@dataclass(frozen=True)
class Entity:
    module: str
    name: str
    kind: str

    @property
    def key(self) -> str:
        return f"{self.module}.{self.name}"

    @property
    def table(self) -> str:
        return f"{self.module}_{self.name}"


ENTITIES = {e.key: e for module, kinds in _NAMES.items() for kind, names in kinds.items() for name in names.split() for e in [Entity(module, name, kind)]}


#: Filter keys declared for an entity, and patterns of further ones.
_DECLARED: dict[str, tuple[frozenset[str], tuple[str, ...]]] = {}


def declare(entity: str, keys: Iterable[str], patterns: Iterable[str] = ()) -> None:
    """State the filter keys of an entity; from then on no others pass, nor any from_, to_ or plural form that is not among them."""
    if entity not in ENTITIES:
        raise KeyError(f"unknown entity {entity}")
    _DECLARED[entity] = (frozenset(keys), tuple(patterns))


def undeclare(entity: str) -> None:
    """Go back to the columns of the entity's table."""
    _DECLARED.pop(entity, None)


def check_module(entity: str, module: str | None) -> None:
    """Raise where an entity of two modules is not given one of them, or any other entity is given one."""
    twin = ENTITIES[entity].kind == "twin"
    if twin and module not in _TWINS:
        raise ValueError(f"{entity}: module must be one of {', '.join(_TWINS)}")
    if not twin and module is not None:
        raise ValueError(f"{entity}: takes no module")


def check_filter(entity: str, filters: Mapping[str, object], columns: list[str]) -> None:
    """Raise before any read: unknown entity, missing or exclusive arguments, unknown keys."""
    if entity not in ENTITIES:
        raise KeyError(f"unknown entity {entity}")
    missing = [a for a in _REQUIRED.get(entity, ()) if filters.get(a) in (None, "")]
    if missing:
        raise ValueError(f"{entity}: missing {', '.join(missing)}")
    if (pair := _EXCLUSIVE.get(entity)) and all(filters.get(a) for a in pair):
        raise ValueError(f"{entity}: give one of {' and '.join(pair)}")
    known: set[str] | frozenset[str] = {*columns, *(f"from_{c}" for c in columns), *(f"to_{c}" for c in columns), *(f"{c}s" for c in columns)}
    patterns = [_EXTENSIONS[entity]] if entity in _EXTENSIONS else []
    if entity in _DECLARED:
        known, more = _DECLARED[entity]
        patterns += more
    unknown = [k for k in filters if k not in known and not any(re.fullmatch(p, k) for p in patterns)]
    if unknown:
        raise ValueError(f"{entity}: unknown filter {', '.join(sorted(unknown))}")


def predicate(filters: Mapping[str, object], columns: list[str]) -> Column:
    """All keys must hold; a list of values means any of them; from_ and to_ are inclusive; null values do not filter."""
    out = F.lit(True)
    for key, value in filters.items():
        if value is None:
            continue
        if key not in columns and key.startswith("from_"):
            out = out & (F.col(key[5:]) >= F.lit(value))
        elif key not in columns and key.startswith("to_"):
            out = out & (F.col(key[3:]) <= F.lit(value))
        else:
            name = key if key in columns or not key.endswith("s") else key[:-1]
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            out = out & F.col(name).isin(*values)
    return out


def scan(spark: SparkSession, folder: str, entity: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    """The rows of an entity's landed table; the filters reach the parquet scan."""
    if entity not in ENTITIES:
        raise KeyError(f"unknown entity {entity}")
    df = spark.read.parquet(f"{folder}/{ENTITIES[entity].table}.parquet")
    check_filter(entity, filters or {}, df.columns)
    return df.where(predicate(filters or {}, df.columns))


@dataclass(frozen=True)
class Request:
    """What a service is asked for one page; ``params`` are texts, the numbers of a ``body`` are numbers."""

    entity: str
    params: dict[str, str]
    body: dict[str, object] | None = None
    module: str | None = None
    headers: dict[str, str] | None = None


def request(entity: str, filters: Mapping[str, object], page: int, size: int, *, module: str | None = None, company: str | None = None) -> Request:
    """The request of a page by the entity's kind: filters and page as parameters; with ``post`` the filters in the body; with ``body`` all in the body; without a page where all rows come at once.

    Null filters are left out. A company goes into a header of entities of two modules alone.
    """
    kind = ENTITIES[entity].kind
    given = {k: v for k, v in filters.items() if v is not None}
    texts = {k: ",".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v) for k, v in given.items()}
    at = {"page": str(page), "size": str(size)}
    if kind == "post":
        return Request(entity, at, dict(given))
    if kind == "body":
        return Request(entity, {}, {**given, "page": page, "size": size})
    if kind == "twin":
        return Request(entity, {**texts, **at}, None, module, {"company": company} if company else None)
    return Request(entity, texts if kind in ("bare", "tree", "lookup") else {**texts, **at})


def scan_service(
    spark: SparkSession, entity: str, fetch: Callable[[Request], object], filters: Mapping[str, object] | None = None, *, columns: Sequence[str] = (), module: str | None = None, company: str | None = None, size: int = 100, max_pages: int = 1000, path: str | None = None
) -> tuple[DataFrame, bool]:
    """(page, ordinal, item as JSON) of an entity behind a service, and whether ``max_pages`` left pages out.

    All checks come before the first call. ``fetch`` takes a ``Request`` and runs on the executors.
    ``path`` names a list below the entity; it is paged whatever the kind and is asked with the
    path as parameter ``path``.
    """
    if entity not in ENTITIES:
        raise KeyError(f"unknown entity {entity}")
    check_module(entity, module)
    check_filter(entity, filters or {}, list(columns))
    at_once = ENTITIES[entity].kind in ("bare", "tree", "lookup") and path is None

    def page(n: int, size: int) -> object:
        r = request(entity, filters or {}, n, size, module=module, company=company)
        return fetch(replace(r, params={**r.params, "path": path, "page": str(n), "size": str(size)}) if path else r)

    return scan_pages(spark, page, size=size, max_pages=1 if at_once else max_pages, wave=1 if at_once else 32, read=whole if at_once else envelope)


def get(spark: SparkSession, folder: str, entity: str, key: str, value: object) -> DataFrame:
    """One row by key."""
    return scan(spark, folder, entity).where(F.col(key) == F.lit(value)).limit(1)


def descendants(edges: DataFrame, roots: DataFrame, *, parent: str = "parent", child: str = "child", max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of trees given as edges, by joins level by level until one is empty; a node met again is not followed twice.

    With ``max_depth`` set, nodes below it are an error.
    """
    from plumbline.session import cut_lineage

    level = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    seen = level = cut_lineage(level)
    for depth in count(1):
        nxt = level.join(edges.select(F.col(parent).alias("node"), F.col(child).alias("next")), "node").select("root", F.col("next").alias("node"), F.lit(depth).alias("depth")).distinct()
        level = cut_lineage(nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if level.isEmpty():
            return seen
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"nodes below depth {max_depth}")
        seen = seen.unionByName(level)
        if depth % 20 == 0:
            seen = cut_lineage(seen)
