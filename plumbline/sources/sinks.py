"""Results, reports, state tables and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.operators.windows import capped_sections
from plumbline.session import drop_folder


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One parquet table per result."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_summary(df: DataFrame, path: str) -> None:
    """A small summary as one line of JSON per row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def flagged(df: DataFrame, flags: Mapping[str, Column], name: str = "flag") -> DataFrame:
    """The name of the first condition that holds, as a column."""
    return df.withColumn(name, F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in flags.items()]))


def report_lines(df: DataFrame, section: str, text: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """(section, position, line): a capped report with a last line that counts the rest of a section."""
    c = capped_sections(df, section, order, cap)
    lines = c.select(section, "position", text.alias("line"))
    rest = c.where("n_more > 0").select(section, F.lit(cap + 1).alias("position"), F.concat(F.lit("and "), F.col("n_more").cast("string"), F.lit(" more")).alias("line")).distinct()
    return lines.unionByName(rest)


def _exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


#: Buckets of a state table; fixed when it is first written, since a key's bucket follows from it.
BUCKETS = 64


def _pointer(spark: SparkSession, folder: str) -> DataFrame | None:
    """(bucket, version): the current version of each bucket of a state table, a row per bucket at most; None without a state."""
    log = _exists(spark, f"{folder}/current")
    return None if log is None else log.groupBy("bucket").agg(F.max("version").alias("version"))


def _read_buckets(spark: SparkSession, folder: str, pointer: DataFrame) -> DataFrame:
    """The current rows; each bucket from the folder of its version, so nothing else is read."""
    paths = [f"{folder}/data/version={r.version}/bucket={r.bucket}" for r in pointer.collect()]
    return spark.read.option("basePath", f"{folder}/data").parquet(*paths).drop("version", "bucket")


def upsert(spark: SparkSession, folder: str, rows: DataFrame, key: str, order: str) -> str:
    """Merge rows into a state table: the greatest ``order`` per key wins. Returns the new version's path.

    Only the buckets that the rows fall into are read and written again. Versions are written side
    by side, and rows of a log name the current one of each bucket, so a reader never sees half a
    state and a repeated batch changes nothing. A bucket keeps its current version and the one
    before, for readers that are under way; older ones are deleted. An empty batch writes a
    version without rows.
    """
    names = rows.columns
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    touched = {r.bucket for r in bucketed.select("bucket").distinct().collect()}
    log = _exists(spark, f"{folder}/current")
    known: dict[int, list[int]] = {}
    for r in [] if log is None else log.select("bucket", "version").collect():
        known.setdefault(r.bucket, []).append(r.version)
    version = max((v for versions in known.values() for v in versions), default=0) + 1
    both, old = bucketed, [f"{folder}/data/version={max(known[b])}/bucket={b}" for b in sorted(touched & known.keys()) if b >= 0]
    if old:
        both = both.unionByName(spark.read.schema(bucketed.schema).option("basePath", f"{folder}/data").parquet(*old).select(*bucketed.columns))
    rest = [c for c in names if c != key]
    merged = both.groupBy("bucket", key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("r")).select("bucket", key, "r.*").select("bucket", *names)
    path = f"{folder}/data/version={version}"
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    entries = spark.createDataFrame([(b, version) for b in sorted(touched)] or [(-1, version)], "bucket int, version long")
    entries.coalesce(1).write.mode("append").parquet(f"{folder}/current")
    for bucket in touched & known.keys():
        for stale in sorted(known[bucket])[:-1]:
            drop_folder(spark, f"{folder}/data/version={stale}/bucket={bucket}")
    return path


def state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current rows of a state table, or None where nothing was ever written."""
    pointer = _pointer(spark, folder)
    if pointer is None:
        return None
    filled = pointer.where("bucket >= 0")
    return _read_buckets(spark, folder, filled) if not filled.isEmpty() else None


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def newest(log: DataFrame, by: str, n: int) -> DataFrame:
    """The newest n records of a log."""
    return log.orderBy(F.col(by).desc()).limit(n)


def html_report(lines: DataFrame, section: str, title: str, most: int = 100_000) -> str:
    """A page of capped sections (see ``report_lines``); more than ``most`` lines in all are an error, since no reader and no driver has use for them."""
    from html import escape

    if lines.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} lines")

    out, last = [f"<h1>{escape(title)}</h1>"], None
    for r in lines.orderBy(section, "position").collect():
        if r[section] != last:
            last = r[section]
            out.append(f"<h2>{escape(str(last))}</h2>")
        out.append(f"<p>{escape(r['line'] or '')}</p>")
    return "\n".join(out)
