"""The library's own functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.functions.tables import TableRows
from plumbline.operators.rules import similarity
from plumbline.operators.units import canonical_udf


def register(spark: SparkSession) -> None:
    """``text_similarity(a, b)``, ``to_canonical_unit(value, unit)`` and the table function ``table_rows(text)``."""
    spark.udf.register("text_similarity", similarity)
    spark.udf.register("to_canonical_unit", canonical_udf)
    spark.udtf.register("table_rows", TableRows)
