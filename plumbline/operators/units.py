"""Prices and quantities in common units.

Texts are parsed by ``plumbline.functions.measures`` in Arrow batches beside the scan, so nothing
is shuffled for it. Equal prices are then found with an equi-join on entity, dimension and a
logarithmic price bucket (or its neighbour), never by comparing all records of an entity.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import measures
from plumbline.functions.text import is_blank
from plumbline.session import cut_lineage


@F.arrow_udf(T.StructType([T.StructField("scale", T.DoubleType()), T.StructField("dim", T.StringType())]))
def _basis(unit: pa.Array, desc: pa.Array) -> pa.Array:
    got = list(map(measures.price_basis, unit.to_pylist(), desc.to_pylist()))
    scale = pa.array([g and g[0] for g in got], pa.float64())
    return pa.StructArray.from_arrays([scale, pa.array([g and measures.DIMENSIONS[g[1].index(1)] for g in got], pa.string())], ["scale", "dim"])


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("dim", T.ArrayType(T.IntegerType()))]))
def canonical_udf(value: pd.Series, unit: pd.Series) -> pd.DataFrame:
    units = [measures.parse_unit(measures.plain(u)) if u else None for u in unit]
    return pd.DataFrame(
        {
            "value": pd.Series([u.to_canonical(float(v)) if u and v is not None and v == v else None for v, u in zip(value, units)], dtype="float64"),
            "dim": [list(u.dim) if u else None for u in units],
        }
    )


def to_canonical(value: Column, unit: Column) -> Column:
    """struct(value, dim): a quantity in the canonical unit of its dimension; nulls where the unit is unknown or null."""
    return canonical_udf(value.cast("double"), unit.cast("string"))


def price_per_common_unit(records: DataFrame) -> DataFrame:
    """``records`` with common_unit (piece, metre, kilogram), unit_scale and common_price.

    The three are null where the basis cannot be known or unit_price is null. Every row is kept,
    repeated rows and extra columns included; columns of these three names are replaced.
    """
    with_basis = records.withColumn("common_price", _basis(F.col("material_unit"), F.col("material_desc")))
    return with_basis.withColumns(
        {
            "common_unit": F.col("common_price.dim"),
            "unit_scale": F.col("common_price.scale"),
            "common_price": F.col("unit_price") / F.col("common_price.scale"),
        }
    )


def same_price_classes(records: DataFrame, tolerance: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each record, and the linked classes.

    A class is (m, s, u, p, c): material, supplier, common unit, price as written and per common
    unit. members has r, the record_id, and b, a price bucket, besides; links has m, s, u and
    p1, c1, p2, c2 of two classes whose prices as written differ by more than ``tolerance`` while
    those per common unit agree within it. Who takes part: see ``same_price_pairs``.
    """
    priced = price_per_common_unit(
        records.where(~is_blank(F.col("material_id")) & ~is_blank(F.col("supplier_id")) & (F.col("unit_price") > 0) & F.col("record_id").isNotNull())
        .select("record_id", "material_id", "supplier_id", "unit_price", "material_unit", "material_desc")
    )
    width = math.log1p(2 * tolerance)
    # Read several times, so the texts are parsed once and the few columns written.
    members = cut_lineage(priced.where(F.col("common_price").isNotNull() & (F.col("common_price") < float("inf"))).select(
        F.col("record_id").alias("r"), F.col("material_id").alias("m"), F.col("supplier_id").alias("s"), F.col("common_unit").alias("u"),
        F.col("unit_price").alias("p"), F.col("common_price").alias("c"), F.floor(F.ln("common_price") / width).alias("b"),
    ).distinct())
    classes = members.groupBy("m", "s", "u", "p", "c", "b").agg(F.lit(1).alias("one")).drop("one")
    left = classes.select("m", "s", "u", F.col("p").alias("p1"), F.col("c").alias("c1"), F.explode(F.array("b", F.col("b") + 1)).alias("b"), F.col("b").alias("b1"))
    right = classes.select("m", "s", "u", F.col("p").alias("p2"), F.col("c").alias("c2"), "b")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= tolerance * F.greatest(x, y)
    links = left.join(right, ["m", "s", "u", "b"]).where(((F.col("b") > F.col("b1")) | (F.col("p1") < F.col("p2"))) & near("c1", "c2") & ~near("p1", "p2"))
    return members, links.select("m", "s", "u", "p1", "c1", "p2", "c2")


def same_price_pairs(records: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(record_id_a, record_id_b): records of one material and supplier whose prices as written differ
    by more than ``tolerance`` while those per common unit agree within it.

    Records with a blank key, without a price above zero or without a known basis take no part;
    exact repeats count once; a null record_id takes no part. Records that share price and basis
    form one class; classes are joined, not records, so a hot entity with one price costs one row.
    The pairs are the members of linked classes; whoever needs no pairs reads the classes instead.
    """
    members, links = same_price_classes(records, tolerance)
    a = members.select("m", "s", "u", F.col("p").alias("p1"), F.col("c").alias("c1"), F.col("r").alias("r1"))
    b = members.select("m", "s", "u", F.col("p").alias("p2"), F.col("c").alias("c2"), F.col("r").alias("r2"))
    found = links.join(a, ["m", "s", "u", "p1", "c1"]).join(b, ["m", "s", "u", "p2", "c2"]).where("r1 <> r2")
    return found.select(F.least("r1", "r2").alias("record_id_a"), F.greatest("r1", "r2").alias("record_id_b")).distinct()
