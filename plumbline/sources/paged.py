"""Scans of paged services and of landed pages.

A page is JSON in one of several envelopes. ``scan_pages`` calls a fetch function in parallel
waves; ``PagedJson`` is a data source over pages that were landed as files, one partition a page.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.session import cut_lineage

#: Keys under which an envelope may hold its rows, in order. Fixed values.
ROW_KEYS = ("content", "records", "items", "list")
_TOTAL_KEYS = ("totalElements", "total", "totalCount")
PAGE_SCHEMA = "page int, ordinal int, item string"


@dataclass
class Page:
    items: list
    total: int | None
    has_next: bool


def normalize(raw, size: int) -> Page:
    """Rows, total and whether another page follows, from any envelope.

    A list is its own rows, any other single object one row. The total is unknown where it is
    missing, no integer, or less than the rows at hand. Without a ``last`` flag a full page has a
    next one.
    """
    if raw is None:
        return Page([], None, False)
    if isinstance(raw, list):
        return Page(raw, None, len(raw) >= size)
    if not isinstance(raw, dict):
        return Page([raw], None, False)
    key = next((k for k in ROW_KEYS if isinstance(raw.get(k), list)), None)
    if key is None:
        return Page([raw], None, False)
    items = raw[key]
    total = next((raw[k] for k in _TOTAL_KEYS if isinstance(raw.get(k), int) and not isinstance(raw[k], bool)), None)
    if total is not None and total < len(items):
        total = None
    last = raw.get("last")
    return Page(items, total, (not last) if isinstance(last, bool) else len(items) >= size)


def envelope(raw, size: int) -> Page:
    """``normalize`` for a service that pages: rows come from the envelope's list alone, so an envelope without one has none."""
    if not isinstance(raw, dict) or not any(isinstance(raw.get(k), list) for k in ROW_KEYS):
        return Page([], None, False)
    return normalize(raw, size)


def whole(data, size: int = 0) -> Page:
    """The rows of a service that gives everything at once: a list, the list under ``items``, or one object; there is never a next page."""
    if isinstance(data, dict):
        data = data["items"] if isinstance(data.get("items"), list) else [data]
    return Page(data, len(data), False) if isinstance(data, list) else Page([], 0, False)


class Retrying:
    """A fetch function that is called up to ``attempts`` times, ``wait`` seconds apart and twice as long after each failure."""

    def __init__(self, fetch: Callable, attempts: int = 3, wait: float = 2.0):
        self.fetch, self.attempts, self.wait = fetch, attempts, wait

    def __call__(self, *args):
        for n in range(1, self.attempts + 1):
            try:
                return self.fetch(*args)
            except Exception:  # noqa: BLE001 - whatever failed, the last failure is the caller's
                if n == self.attempts:
                    raise
                time.sleep(self.wait * 2 ** (n - 1))


def _rows(page: int, p: Page) -> Iterator[tuple[int, int, str]]:
    for i, item in enumerate(p.items):
        yield page, i, json.dumps(item, ensure_ascii=False)


def scan_pages(spark: SparkSession, fetch: Callable[[int, int], object], *, size: int = 100, max_pages: int = 1000, wave: int = 32, read: Callable[[object, int], Page] = normalize) -> tuple[DataFrame, bool]:
    """All rows of a paged service as (page, ordinal, item as JSON), and whether ``max_pages`` cut it off.

    ``fetch(page, size)`` runs on the executors, ``wave`` pages at a time; ``read`` takes its answer
    apart (``envelope``, ``whole``, or ``normalize`` for either). The driver sees one flag per page.
    Each wave is written to the shared folder, so no page is fetched twice.
    """
    out, start = None, 0
    while start < max_pages:
        n = min(wave, max_pages - start)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for page in pdf["id"].tolist():
                    p = read(fetch(int(page), size), size)
                    rows = list(_rows(int(page), p)) or [(int(page), -1, None)]
                    yield pd.DataFrame({"page": [r[0] for r in rows], "ordinal": [r[1] for r in rows], "item": [r[2] for r in rows], "has_next": p.has_next})

        got = cut_lineage(spark.range(start, start + n, 1, n).mapInPandas(run, PAGE_SCHEMA + ", has_next boolean"))
        stop = got.where("not has_next").agg(F.min("page")).head()[0]
        part = got.where("ordinal >= 0" + (f" and page <= {stop}" if stop is not None else "")).drop("has_next")
        out = part if out is None else out.unionByName(part)
        if stop is not None:
            return out, False
        start += n
    return (out if out is not None else spark.createDataFrame([], PAGE_SCHEMA)), True


def _marked(rows: list[tuple], none: tuple, truncated: bool) -> Iterator[tuple]:
    """Rows with the mark whether others were left out behind them; the row ``none`` carries it where there are no rows."""
    for r in rows or ([none] if truncated else []):
        yield *r, truncated


class _PagePartition(InputPartition):
    def __init__(self, page: int, path: str, truncated: bool):
        self.page, self.path, self.truncated = page, path, truncated


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.max_pages, self.size = options["path"], options.get("maxPages"), int(options.get("size", "100"))
        if self.max_pages is not None and int(self.max_pages) < 1:
            raise ValueError("maxPages must be at least 1")

    def partitions(self):
        found = sorted((int(m[1]), f) for f in os.listdir(self.folder) if (m := re.fullmatch(r"page-(\d+)\.json", f)))
        end = len(found) if self.max_pages is None else min(int(self.max_pages), len(found))
        return [_PagePartition(n, os.path.join(self.folder, f), i == end and end < len(found)) for i, (n, f) in enumerate(found[:end], 1)]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield from _marked(list(_rows(partition.page, normalize(json.load(f), self.size))), (partition.page, -1, None), partition.truncated)


class PagedJson(DataSource):
    """``spark.dataSource.register(PagedJson)``, then ``spark.read.format("paged_json").load(folder)``.

    All pages are read unless the option ``maxPages`` is set. If it leaves pages out, the rows of
    the last page read are marked ``truncated``; where that page has none, one with ordinal -1 and
    null item is.
    """

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return PAGE_SCHEMA + ", truncated boolean"

    def reader(self, schema):
        return _PageReader(self.options)


def merged_chunks(pages: DataFrame, key: str = "$.id") -> DataFrame:
    """Rows of several scans by their key: the last in the order of page and position wins."""
    keyed = pages.where("item is not null").withColumn("key", F.get_json_object("item", key))
    return keyed.groupBy("key").agg(F.max_by("item", F.struct("page", "ordinal")).alias("item"), F.min(F.struct("page", "ordinal")).alias("first"))


def scan_slices(
    spark: SparkSession, fetch: Callable[[int, int], list[dict]], start_ms: int, end_ms: int, *, slice_ms: int = 43_200_000, overlap_ms: int = 600_000, full: int = 20, max_depth: int = 10, id_key: str = "id"
) -> DataFrame:
    """(id, item, incomplete) of a service that lists by time and returns at most ``full`` rows a call.

    The span is cut into slices that reach back by ``overlap_ms``; a full answer halves its slice,
    up to ``max_depth`` times, beyond which the slice's rows are marked incomplete. Slices run in
    parallel, every id comes out once.
    """

    def call(a: int, b: int, depth: int) -> Iterator[tuple[dict, bool]]:
        rows = fetch(a, b)
        if len(rows) >= full and depth < max_depth and b - a > 1:
            middle = (a + b) // 2
            yield from call(a, middle, depth + 1)
            yield from call(middle, b, depth + 1)
        else:
            for r in rows:
                yield r, len(rows) >= full

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"].tolist():
                a = start_ms + s * slice_ms
                got = list(call(max(start_ms, a - overlap_ms), min(end_ms, a + slice_ms), 0))
                yield pd.DataFrame({"id": [str(r[id_key]) for r, _ in got], "item": [json.dumps(r, ensure_ascii=False) for r, _ in got], "incomplete": [x for _, x in got]}).astype({"incomplete": "bool"})

    n = max(0, -(-(end_ms - start_ms) // slice_ms))
    got = spark.range(0, n, 1, max(1, n)).mapInPandas(run, "id string, item string, incomplete boolean")
    return got.groupBy("id").agg(F.max("item").alias("item"), F.bool_and("incomplete").alias("incomplete"))


def scan_cursor(spark: SparkSession, fetch: Callable[[str | None], tuple[list[dict], str | None]], max_calls: int | None = None) -> DataFrame:
    """(call, item, truncated) of a service that hands on a cursor; calls follow one another in one task that yields as it reads.

    The cursor is followed to its end unless ``max_calls`` is set. If it stops the calls with a
    cursor still open, the rows of the last call are marked truncated; where that call has none,
    one with null item is.
    """
    if max_calls is not None and max_calls < 1:
        raise ValueError("max_calls must be at least 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            cursor = None
            for n in count():
                rows, cursor = fetch(cursor)
                last = n + 1 == max_calls
                got = list(_marked([(n, json.dumps(r, ensure_ascii=False)) for r in rows], (n, None), last and bool(cursor)))
                yield pd.DataFrame(got, columns=["call", "item", "truncated"]).astype({"call": "int64", "truncated": "bool"})
                if last or not cursor:
                    break

    return spark.range(1).coalesce(1).mapInPandas(run, "call long, item string, truncated boolean")


def fetch_details(ids: DataFrame, fetch: Callable[[str], object], *, id: str, threads: int = 8) -> DataFrame:
    """(id, item, error): one call per id, ``threads`` at a time in each task; a failed call gives its error and stops nothing."""

    def one(key: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(fetch(key), ensure_ascii=False), None
        except Exception as e:  # noqa: BLE001 - any failure of one call is that row's result
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf["id"].tolist()))
                yield pd.DataFrame({"id": pdf["id"], "item": [g[0] for g in got], "error": [g[1] for g in got]})

    return ids.select(F.col(id).cast("string").alias("id")).where("id is not null").mapInPandas(run, "id string, item string, error string")


def enriched(headers: DataFrame, sources: Mapping[str, Callable[[str], object]], *, id: str, threads: int = 5) -> DataFrame:
    """``headers`` with a column of JSON for each source, and ``<source>_error``.

    Each distinct id is fetched once from each source. A failed call leaves that source null for that
    header and states the error, stops nothing and touches no other source; an answer without items
    is JSON all the same, so "failed" and "none" can be told apart. Every header stays, those
    without id with nulls.
    """
    out = headers
    for name, fetch in sources.items():
        got = fetch_details(headers.select(F.col(id).cast("string").alias("id")).distinct(), fetch, id="id", threads=threads)
        got = got.select(F.col("id").alias(f"__{name}"), F.col("item").alias(name), F.col("error").alias(f"{name}_error"))
        out = out.join(got, F.col(id).cast("string") == F.col(f"__{name}"), "left").drop(f"__{name}")
    return out
