"""Distribution reports over clusters, counts and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.plans.lineage import Lineage


def cluster_stats(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """clusters, edges, avg_edges, avg_names of sizes(total_count, members)."""
    return sizes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("total_count").alias("edges"), F.avg("total_count").alias("avg_edges"), F.avg("members").alias("avg_names")
    )


def entropy(sizes: DataFrame, column: str = "total_count") -> DataFrame:
    """bits and normalized (by log2 of the number of clusters; 0 for one)."""
    x = F.col(column).cast("double")
    sums = sizes.agg(F.sum(x).alias("t"), F.sum(x * F.log2(x)).alias("h"), F.count(F.lit(1)).alias("k"))  # -sum(x / t * log2(x / t)), one pass
    bits = sums.select((F.log2("t") - F.col("h") / F.col("t")).alias("bits"), "k")
    return bits.select("bits", F.when(F.col("k") > 1, F.col("bits") / F.log2(F.col("k").cast("double"))).otherwise(0.0).alias("normalized"))


def retention(sizes: DataFrame, names: DataFrame) -> DataFrame:
    a = sizes.agg(F.count(F.lit(1)).alias("clusters"))
    b = names.agg(F.count_distinct("name").alias("names"))
    return a.crossJoin(b).select("clusters", "names", (F.col("clusters") / F.col("names")).alias("ratio"))  # one row each


def histogram_overflow(rows: DataFrame, column: str, cutoff: int) -> DataFrame:
    return rows.groupBy(F.when(F.col(column) > cutoff, cutoff + 1).otherwise(F.col(column)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_bin(c: Column, base: float = 2.0) -> Column:
    return F.floor(F.log(float(base), c.cast("double")) + 1e-9).cast("long")


def histogram_log(rows: DataFrame, column: str, base: float = 2.0) -> DataFrame:
    return rows.where(F.col(column) > 0).groupBy(log_bin(F.col(column), base).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cdf(rows: DataFrame, column: str, lineage: Lineage | None = None) -> DataFrame:
    """(value, n, cdf) where ties share the place of their last row: aggregated by value first, then summed within ranges of
    the value; what stands before a range comes from one row for each."""
    by = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = (lineage or Lineage(rows.sparkSession)).cut(by.repartitionByRange("value").select("value", "n", F.spark_partition_id().alias("part")))
    starts = _starts(ordered.groupBy("part").agg(F.sum("n").alias("n")))
    place = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    return ordered.withColumn("place", place).join(F.broadcast(starts), "part").select("value", "n", ((F.col("start") + F.col("place")) / F.col("total")).alias("cdf"))


def _starts(sizes: DataFrame) -> DataFrame:
    """(part, start, total) of sizes(part, n), a row for each range: how many stand before it, and in all."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("part", before.alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))


def cdf_rows(rows: DataFrame, column: str, lineage: Lineage) -> DataFrame:
    """(value, cdf) of every row whose value is not null: its place by value over the number of rows, ties one after
    another. Rows go to ranges of the value, those of one frequent value to several by a salt, so that a window sees one
    range; the places before a range come from one row for each."""
    salted = rows.select(F.col(column).alias("value")).where("value is not null").withColumn("salt", F.rand(1))
    ordered = lineage.cut(salted.repartitionByRange("value", "salt").select("value", F.spark_partition_id().alias("part")))
    starts = _starts(ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return ordered.withColumn("place", place).join(F.broadcast(starts), "part").select("value", ((F.col("start") + F.col("place")) / F.col("total")).alias("cdf"))


# Phrases of log messages and the classes they tell, in order of priority.
ERROR_PHRASES = (
    ("Pydantic validation", "Pydantic validation"),
    ("Using empty fallback structure instead", "Fallback empty structure"),
    ("JSON parsing error from Ollama", "JSON parsing error"),
    ("JSONDecodeError from Ollama", "JSON parsing error"),
    ("Unexpected response type from Ollama", "Unexpected type"),
    ("core exception", "Core exception"),
)


def error_bucket(c: Column, phrases: Sequence[tuple[str, str]] = ERROR_PHRASES, other: str = "Other") -> Column:
    """The class of an error message by the first of the phrases it holds, letter by letter."""
    return F.coalesce(*(F.when(c.contains(phrase), kind) for phrase, kind in phrases), F.lit(other))


def run_sums(runs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the numbers of runs(chunks, errors, warnings, seconds) by the columns given, with errors a chunk."""
    sums = runs.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("chunks", "errors", "warnings", "seconds")))
    return sums.withColumn("errors_per_chunk", F.when(F.col("chunks") > 0, F.col("errors") / F.col("chunks")))


def distinct_share(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """distinct, total and per_distinct (rows for each distinct value) of a column."""
    out = rows.groupBy(*(by or [])).agg(F.count_distinct(column).alias("distinct"), F.count(column).alias("total"))
    return out.withColumn("per_distinct", F.when(F.col("distinct") > 0, F.col("total") / F.col("distinct")))


def counts_by(rows: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """Rows for each value of a key: names, types, days."""
    return rows.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return counts_by(rows, key, name).where("n > 1")


def latest_by_chunk(rows: DataFrame, keys: list[str], chunk: str = "chunk") -> DataFrame:
    """Of rows with the same keys the one of the lexically last chunk folder, as later folders overwrite earlier ones."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(chunk, *(c for c in others if c != chunk))).alias("__m")).select(*keys, "__m.*")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric rows (metric, value) of two versions with delta and percent."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    return a.join(b, "metric").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).alias("percent"))
