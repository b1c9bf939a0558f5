"""The queries without SQL over the smallest tables, whole, against brute force; and what was found missing before."""

import collections
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import test_text  # noqa: E402

from plumbline.llm import bpe, queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def documents(spark):
    return {(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@needs_tables
def test_p1_found(spark):
    groups = {}
    for r in spark.read.parquet(f"{SF}/material.parquet").select("code", "name", "mat_desc").distinct().collect():
        form = tuple(test_text.looks(x or "") for x in (r.name, r.mat_desc))
        if r.code is not None and "".join(form).strip(" "):
            groups.setdefault(form, set()).add((r.code, r.name or "", r.mat_desc or ""))
    want = {(a[0], b[0]) for g in groups.values() for a in g for b in g if a[0] < b[0] and a[1:] != b[1:]}
    assert rows_of(queries.p1_found(spark, SF)) == collections.Counter(want) and want


@needs_tables
def test_p8_ids(spark):
    tiktoken = pytest.importorskip("tiktoken")
    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})
    got = queries.p8_ids(spark, SF).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in got} == {(i, tuple(e.encode_ordinary(t or ""))) for i, t in documents(spark)}


@needs_tables
def test_p9_containers(spark):
    got = queries.p9_containers(spark, SF)
    sizes = {i: len(bpe.encoder().encode_batch([t or ""])[0]) for i, t in documents(spark)}
    fill, size = {}, {}
    n = next(c for c in got.columns if c in ("n_tokens", "n", "size"))
    for r in got.collect():
        fill[r.container] = fill.get(r.container, 0) + r[n]
        size[r.doc_id] = size.get(r.doc_id, 0) + r[n]
    assert max(fill.values()) <= 2048 and {i: s for i, s in size.items() if s} == {i: s for i, s in sizes.items() if s}
    assert len(fill) <= -(-sum(sizes.values()) // 2048) * 1.05 + 1


@needs_tables
def test_p10_found(spark):
    want = {(i, a, b) for i, t in documents(spark) if t for a, b in test_text.split(t)}
    assert rows_of(queries.p10_found(spark, SF)) == collections.Counter(want) and want


def test_sentences_are_cut_from_the_text(spark):
    from plumbline.llm.sentences import sentence_spans

    df = spark.createDataFrame([(1, " 😀好。Why? x."), (1, "A b."), (2, None), (3, " ")], "doc_id long, text string")
    got = sentence_spans(df, sentence="sentence")
    assert got.columns == ["doc_id", "sent_start", "sent_end", "sentence"]
    assert rows_of(got) == collections.Counter([(1, 1, 4, "😀好。"), (1, 4, 8, "Why?"), (1, 9, 12, "x."), (1, 0, 4, "A b.")])
