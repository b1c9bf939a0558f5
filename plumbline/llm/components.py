"""Groups of records that are linked directly or through others, by low-diameter decomposition.

Every vertex draws an exponentially distributed head start. Clusters grow from all vertices at
once, each delayed by what its head start lacks, and a vertex joins the cluster that reaches it
first; growth stops after ``ROUNDS`` rounds of messages along the edges, which bounds the radius.
Clusters are then contracted to super-vertices, parallel edges merge, and the edges between
clusters are decomposed again until none is left; the assignments of all levels are composed at
the end. A level leaves about a quarter of the edges even of a single long chain, so levels grow
with the logarithm of their number and all levels together cost little more than the first.

Vertices are dense integers, and what a vertex knows is one integer, head start above, centre
below, so every round is one join and one hash aggregation of integers with map-side combining. The
first round needs no join, since a head start follows from the vertex's number; in the others an arc
hands on what its source knows to its target and to the source itself, so that a round refers to the
state before it once. Nothing is gathered on the driver but row counts. The edges of a vertex whose
degree exceeds its share are salted, over the more sub-keys the higher the degree; the table of
these vertices has at most 16 x partitions rows by construction and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank, strip
from plumbline.session import cut_lineage, shuffle_partitions

#: Rounds that clusters grow, and the rate of the head starts' distribution.
ROUNDS, RATE = 3, 0.05
#: Bits of a vertex number, and of a head start's fraction of a round.
_ID_BITS, _FRACTION_BITS = 42, 12
_ROUND = 1 << (_ID_BITS + _FRACTION_BITS)
#: Rows of one key below which none is salted.
LEAST_HOT = 20_000


def _start(v: Column, level: int) -> Column:
    """Head start and own number in one integer."""
    # The level as text: a number would be part of the generated code, which is then compiled anew for every level.
    uniform = (F.xxhash64(v, F.lit(str(level))).bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(1)) / F.lit(float(1 << 32))
    lead = F.floor(-F.ln(uniform) / F.lit(RATE) * F.lit(float(1 << _FRACTION_BITS))).cast("long")
    return F.shiftleft(lead, _ID_BITS).bitwiseOR(v)


def _hot(counts: DataFrame, key: str, rows: int) -> DataFrame | None:
    """(key, salts) of the keys of (key, count) that carry more than their share of ``rows``: as many salts as shares; None where no key can."""
    if rows <= LEAST_HOT:
        return None
    share = max(LEAST_HOT, rows // (8 * shuffle_partitions(counts.sparkSession)))
    return F.broadcast(counts.where(F.col("count") > share).select(F.col(key).alias("key"), F.ceil(F.col("count") / share).cast("int").alias("salts")))


def _looked_up(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The inner join of ``rows`` with ``table``, whose first column is unique, on ``key``; rows of a hot key are spread over its salts, to each of which its table row is copied."""
    t = table.withColumnRenamed(table.columns[0], key)
    if hot is None:
        return rows.join(t, key)
    salts = hot.withColumnRenamed("key", key)
    others = [c for c in rows.columns if c != key]
    salted = rows.join(salts, key, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("salts")).cast("int"))).drop("salts")
    copied = t.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return salted.join(copied, [key, "salt"]).drop("salt")


def _decompose(edges: DataFrame, level: int, hot: DataFrame | None) -> DataFrame:
    """(v, center) for every vertex of the undirected edges (a < b)."""
    arcs = edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    # A head start that is used up reaches nobody further.
    reached = F.when(_start(F.col("src"), level) >= _ROUND, _start(F.col("src"), level) - _ROUND)
    state = arcs.select(F.col("dst").alias("v"), reached.alias("best")).groupBy("v").agg(F.max("best").alias("best")).select("v", F.greatest(_start(F.col("v"), level), "best").alias("best"))
    for _ in range(ROUNDS - 1):
        met = _looked_up(arcs, "src", state, hot)
        known = F.array(F.struct(F.col("src").alias("v"), F.col("best")), F.struct(F.col("dst").alias("v"), (F.col("best") - _ROUND).alias("best")))
        state = met.select(F.explode(known).alias("k")).select("k.*").where("best >= 0").groupBy("v").agg(F.max("best").alias("best"))
    return state.select("v", F.col("best").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).alias("center"))


def _numbered(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """(name, v) with dense numbers v, and the edges in these numbers."""
    names = edges.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").count()
    names = cut_lineage(names.select("name", "count", F.monotonically_increasing_id().alias("raw")))
    part = F.shiftright("raw", 33)
    parts = (names.agg(F.max(part)).head()[0] or 0) + 1
    hot = _hot(names, "name", 2 * n_edges)
    names = names.select("name", (F.col("raw").bitwiseAND(F.lit((1 << 33) - 1)) * parts + part).alias("v"))
    for end in ("a", "b"):
        edges = _looked_up(edges, end, names, hot).drop(end).withColumnRenamed("v", f"v{end}")
    return names, edges.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"))


def connected_groups(links: DataFrame) -> DataFrame:
    """(v, group) for every end of ``links`` (a string, b string); group is the smallest member.

    Links with a null end or of a value with itself connect nothing. Repeated and turned links
    count once; an empty table gives no rows. Strings are compared by code point.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    names, edges = _numbered(edges, edges.count())
    edges = cut_lineage(edges)
    levels: list[DataFrame] = []
    while n := edges.count():
        degrees = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
        hot = _hot(degrees, "v", 2 * n)
        clusters = cut_lineage(_decompose(edges, len(levels), hot))
        levels.append(clusters)
        for end in ("a", "b"):
            edges = _looked_up(edges, end, clusters, hot).drop(end).withColumnRenamed("center", f"c{end}")
        edges = cut_lineage(edges.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if not levels:
        return names.select(F.col("name").alias("v"), F.col("name").alias("group"))
    labels = levels[-1]
    for clusters in reversed(levels[:-1]):
        up = labels.select(F.col("v").alias("center"), F.col("center").alias("top"))
        labels = clusters.join(up, "center", "left").select("v", F.coalesce("top", "center").alias("center"))
    named = cut_lineage(names.join(labels, "v").select("name", "center"))
    smallest = named.groupBy("center").agg(F.min("name").alias("group"), F.count("*").alias("count"))
    hot = _hot(smallest, "center", named.count())
    return _looked_up(named, "center", smallest.select("center", "group"), hot).select(F.col("name").alias("v"), "group")


def pair_links(dup_pair: DataFrame) -> DataFrame:
    """(a, b): links that connect what the pairs connect, those of every pair_no whose two sides have a code and differ.

    A side without code (null or blank) or a pair without both sides links nothing. The sides are
    told apart by the first letter of mark. A pair_no delivered several times connects all codes it
    was ever given on side A with all on side B: each code is linked with the smallest of the other
    side, so a pair_no of many codes gives as many links, not their product.
    """
    rows = dup_pair.where(~is_blank(F.col("code")) & F.col("pair_no").isNotNull()).select("pair_no", F.upper(F.substring(strip(F.col("mark")), 1, 1)).alias("side"), "code")
    rows = rows.where("side in ('A', 'B')").distinct()
    least = rows.groupBy("pair_no").agg(*[F.min(F.when(F.col("side") == s, F.col("code"))).alias(f"least_{s}") for s in "AB"])
    other = F.when(F.col("side") == "A", F.col("least_B")).otherwise(F.col("least_A"))
    return rows.join(least, "pair_no").select(F.col("code").alias("a"), other.alias("b")).where("a <> b")


def duplicate_groups(dup_pair: DataFrame) -> DataFrame:
    """(code, group_code): the group of every code that is linked with another."""
    return connected_groups(pair_links(dup_pair)).select(F.col("v").alias("code"), F.col("group").alias("group_code"))
