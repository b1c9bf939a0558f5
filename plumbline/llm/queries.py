"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import encode_documents
from plumbline.llm.components import duplicate_groups
from plumbline.llm.packing import containers
from plumbline.llm.sentences import sentence_spans
from plumbline.llm.survivors import material_claims, surviving, surviving_codes
from plumbline.llm.visual import same_to_the_eye
from plumbline.plans.duck import day as duck_day
from plumbline.plans.duck import unfilled
from plumbline.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_to_the_eye(table(spark, sf, "material"), key="code", fields=("name", "mat_desc"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(table(spark, sf, "dup_pair"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return material_claims(table(spark, sf, "dup_member"), table(spark, sf, "material"), table(spark, sf, "creator_ref"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The code whose value survives; the required rules decide it alone, so no precedence is learned (``p7_by_currency`` does)."""
    return surviving_codes(_claims(spark, sf)).select(F.col("g").alias("dup_group"), F.col("field").alias("field_name"), "code")


def p7_by_currency(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving records where undated values are placed by learned precedence."""
    return surviving(_claims(spark, sf), undated="learned").select(F.col("g").alias("dup_group"), F.col("field").alias("field_name"), "code", "value")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_spans(table(spark, sf, "documents")).distinct()


_CLAIMS = rf"""
WITH c AS (SELECT lower(trim(creator)) AS who, min(trust_rank) AS rank FROM creator_ref GROUP BY 1),
m AS (SELECT DISTINCT dup_group, code FROM dup_member),
r AS (
  SELECT DISTINCT m.dup_group, m.code, t.creator, t.price, t.manufacturer, t.lead_time, coalesce(c.rank, 99) AS rank, {duck_day("t.modify_date")} AS day
  FROM m JOIN material t ON t.code = m.code LEFT JOIN c ON c.who = lower(trim(t.creator)) WHERE m.dup_group IS NOT NULL),
f AS (
  SELECT * FROM (
    SELECT dup_group, code, rank, day, 'creator' AS field_name, creator AS v FROM r UNION ALL SELECT dup_group, code, rank, day, 'price', price FROM r
    UNION ALL SELECT dup_group, code, rank, day, 'manufacturer', manufacturer FROM r UNION ALL SELECT dup_group, code, rank, day, 'lead_time', lead_time FROM r)
  WHERE NOT {unfilled("v")} AND NOT (field_name = 'price' AND coalesce(try_cast(regexp_replace(v, '[¥元, ]', '', 'g') AS DOUBLE), 1) = 0))
"""
SQL = {
    "p4_found": """
WITH RECURSIVE l AS (
  SELECT DISTINCT a.code AS x, b.code AS y FROM dup_pair a JOIN dup_pair b ON a.pair_no = b.pair_no AND a.mark LIKE 'A%' AND b.mark LIKE 'B%'
  WHERE trim(coalesce(a.code, '')) <> '' AND trim(coalesce(b.code, '')) <> '' AND a.code <> b.code),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS code, least(x, min(y)) AS group_code FROM r GROUP BY x""",
    "p7_found": _CLAIMS + """
SELECT dup_group, field_name, code FROM f QUALIFY row_number() OVER (PARTITION BY dup_group, field_name ORDER BY day DESC NULLS LAST, rank, code) = 1""",
    # Steps between the days of a group on which a field had one value; edges by net count; a value is followed by a later dated one, or along an edge where one of both has no day.
    "p7_by_currency": _CLAIMS + """,
d AS (SELECT dup_group, field_name, day, min(v) AS v FROM f WHERE day IS NOT NULL GROUP BY ALL HAVING min(v) = max(v)),
s AS (SELECT field_name, v AS y, lag(v) OVER (PARTITION BY dup_group, field_name ORDER BY day) AS x FROM d),
n AS (SELECT field_name, x, y, count(*) AS n FROM s WHERE x <> y GROUP BY ALL),
e AS (SELECT a.field_name, a.x, a.y FROM n a LEFT JOIN n b ON a.field_name = b.field_name AND a.x = b.y AND a.y = b.x WHERE a.n > coalesce(b.n, 0)),
u AS (SELECT dup_group, field_name, v, max(day) AS day FROM f GROUP BY ALL),
w AS (SELECT u.*, coalesce(u.day < max(u.day) OVER (PARTITION BY dup_group, field_name), false)
    OR EXISTS (SELECT 1 FROM e JOIN u p ON e.y = p.v AND e.field_name = p.field_name WHERE e.field_name = u.field_name AND e.x = u.v AND p.dup_group = u.dup_group AND (u.day IS NULL OR p.day IS NULL)) AS followed FROM u)
SELECT f.dup_group, f.field_name, f.code, f.v AS value FROM f JOIN w USING (dup_group, field_name, v)
QUALIFY row_number() OVER (PARTITION BY dup_group, field_name ORDER BY followed, f.day DESC NULLS LAST, rank, code, v) = 1""",
}

QUERIES = {f.__name__: f for f in (p1_found, p4_found, p7_found, p7_by_currency, p8_ids, p9_containers, p10_found)}
