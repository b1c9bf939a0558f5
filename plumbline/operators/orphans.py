"""References to records that do not exist, or did not at the time.

Parents and references are range-partitioned by key together. Behind the shuffle a task reads its
range in key order: the parents of a key come first and become sorted arrays, each Arrow batch of
references is then probed against them by one vectorised binary search. Only the current batch and
the parents of one key are held. Keys that carry more than their share of the references are
salted: their references spread over as many sub-ranges as they have shares, to each of which their
parents are copied, so that no sub-range holds more than a share however hot a key is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank
from plumbline.session import shuffle_partitions

_NEVER = np.iinfo(np.int64).max


def _cover(code: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Sorted (code, start) and the running latest end of the same code."""
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    # A running maximum that restarts with every code: ends as ranks, lifted by their code's number.
    ends, rank = np.unique(end, return_inverse=True)
    lift = np.cumsum(np.r_[0, code[1:] != code[:-1]]) * (len(ends) + 1) if len(code) else rank
    latest = ends[np.maximum.accumulate(rank + lift) - lift] if len(code) else end
    return code, start, latest


def probe(p_code, p_start, p_end, r_code, r_at) -> np.ndarray:
    """True for each reference (code, at) that lies in [start, end) of some parent of its code."""
    code, start, latest = _cover(np.asarray(p_code), np.asarray(p_start), np.asarray(p_end))
    if not len(code) or not len(r_code):
        return np.zeros(len(r_code), bool)
    # Times as ranks, so that (code, time) packs into one sortable integer.
    times, rank = np.unique(np.concatenate([start, r_at]), return_inverse=True)
    packed = (code.astype(np.int64) << 32) | rank[: len(start)]
    wanted = (np.asarray(r_code).astype(np.int64) << 32) | rank[len(start) :]
    at = np.searchsorted(packed, wanted, side="right") - 1
    ok = at >= 0
    at = np.maximum(at, 0)
    return ok & (code[at] == r_code) & (latest[at] > r_at)


def _misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, salt and side (parents first); yields references that hit no parent."""
    held_key, held_start, held_end = None, np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        encoded = batch.column("k").dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        side = batch.column("side").to_numpy(zero_copy_only=False)
        start = batch.column("lo").to_numpy(zero_copy_only=False)
        end = batch.column("hi").to_numpy(zero_copy_only=False)
        words = encoded.dictionary
        if held_key is not None and words[0].as_py() != held_key:
            held_start = held_end = np.empty(0, np.int64)
        parents = side == 0
        p_code = np.concatenate([np.zeros(len(held_start), np.int64), codes[parents]])
        p_start = np.concatenate([held_start, start[parents]])
        p_end = np.concatenate([held_end, end[parents]])
        refs = np.flatnonzero(~parents)
        miss = refs[~probe(p_code, p_start, p_end, codes[refs], start[refs])]
        if len(miss):
            yield batch.select(["source", "row_id", "lo"]).take(pa.array(miss))
        held_key = words[len(words) - 1].as_py()
        last = p_code == codes[-1]
        held_start, held_end = _disjoint(p_start[last], p_end[last])


def _disjoint(start: np.ndarray, end: np.ndarray):
    """The same cover with as few intervals as can be."""
    if len(start) < 2:
        return start, end
    order = np.argsort(start, kind="stable")
    start, latest = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > latest[:-1]]
    return start[new], latest[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


def _hot_keys(refs: DataFrame, rows: int) -> DataFrame:
    """(k, salts) of the keys above a quarter of a partition's share of ``rows``: at most 4 x partitions of them can exist, with twice as many salts in all, so they may be broadcast."""
    share = max(1, rows // (4 * shuffle_partitions(refs.sparkSession)))
    return F.broadcast(refs.groupBy("k").count().where(F.col("count") > share).select("k", F.ceil(F.col("count") / share).cast("int").alias("salts")))


def orphan_references(parents: DataFrame, references: DataFrame) -> DataFrame:
    """(source, row_id, at) of each reference whose key no parent held at its time.

    ``parents``: k string, lo and hi timestamp (hi null: for ever). ``references``: source string,
    row_id bigint, k string, at timestamp. Blank keys refer to nothing and are left out on both
    sides; parents without lo never existed; references without time are checked against the
    beginning of time and so are orphans, with a null month. Repeated rows give one result row
    each. Empty parents make every reference an orphan; no references give no rows.
    """
    spark = references.sparkSession
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = (
        parents.where(~is_blank(F.col("k")) & F.col("lo").isNotNull())
        .select("k", micros("lo").alias("lo"), F.coalesce(micros("hi"), F.lit(_NEVER)).alias("hi"))
        .where("lo < hi")
        .distinct()
    )
    refs = references.where(~is_blank(F.col("k"))).select("source", "row_id", "k", F.coalesce(micros("at"), F.lit(-(2**63))).alias("lo"))
    hot = _hot_keys(refs, references.count())
    salted_refs = refs.join(hot, "k", "left").select(
        "k",
        F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("salts")), F.lit(0)).cast("int").alias("salt"),
        F.lit(1).alias("side"), "lo", F.lit(0).cast("long").alias("hi"), "source", "row_id",
    )
    salted_parents = held.join(hot, "k", "left").select(
        "k",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))).alias("salt"),
        F.lit(0).alias("side"), "lo", "hi", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("row_id"),
    )
    both = salted_parents.unionByName(salted_refs)
    ranged = both.repartitionByRange("k", "salt").sortWithinPartitions("k", "salt", "side")
    missing = ranged.mapInArrow(_misses, "source string, row_id long, lo long")
    return missing.select("source", "row_id", F.when(F.col("lo") > -(2**63), F.timestamp_micros("lo")).alias("at"))


def material_orphans(material: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, period_month, row_id): rows whose material_id material did not hold at landed_at.

    ``tables``: name -> (table, name of its row id).
    """
    refs = None
    for name, (df, row_id) in tables.items():
        part = df.select(F.lit(name).alias("source"), F.col(row_id).cast("long").alias("row_id"), F.col("material_id").alias("k"), F.col("landed_at").alias("at"))
        refs = part if refs is None else refs.unionByName(part)
    parents = material.select(F.col("material_id").alias("k"), F.col("landed_at").alias("lo"), F.col("deleted_at").alias("hi"))
    found = orphan_references(parents, refs)
    return found.select(F.col("source").alias("table_name"), F.date_format("at", "yyyy-MM").alias("period_month"), "row_id").distinct()
