"""Operator 4: mixing sources to target weights, in DataFrame functions only.

Sources take shares of the mix by weight; a source that would exceed ``cap`` times its own size stops there and the
rest is shared anew, which is the level at which sum(min(weight * level, cap * size)) meets the whole. A source first
gives whole epochs of all its documents. The rest of its target is filled by Efraimidis-Spirakis sampling without
replacement: each document draws -ln(u) / quality, u being fixed by its doc_id, and documents are taken in that order
while their prefix sum stays within the rest; the document at the border is taken if that comes nearer the target.

Prefix sums need no sort of a whole source: keys fall into ``BINS`` bins by their logarithm, so that the bins suit any
level of quality weights, the sums of the bins are aggregated before the shuffle, the one bin in which a source's
border lies is divided into ``FINE`` in the same way, and only the documents of one of these are sorted.

Quality weights are a column of the caller's, ``weight`` (a classifier's score, say), or the default of ``quality``.

Rows: null text has size 0 and is taken 0; null source is a source of its own, the last; null doc_id draws like any
other id; equal rows are documents of their own, and of equal keys the smaller doc_id, then the shorter document comes
first. A null, negative or zero weight is taken as the least positive one. An empty table gives an empty mix. A source
without words gets target 0. Other columns are kept by ``mixed_documents``, whatever their names, and ignored by
``mix_plan``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, quoted, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BINS = 4096
FINE = 65536
#: Keys between exp(-LOGS) and exp(LOGS) have bins of their own.
LOGS = 64.0
#: So many rows of sources may be broadcast to the documents; more of them are joined by shuffle.
SENT_SOURCES = 100_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of runs without blanks and control blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) fixed by the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def quality(chars: Column, size: Column) -> Column:
    """A weight between 0 and 1 that falls as the mean length of a word leaves that of prose (about 6 with its blank)."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(chars.cast("double") / F.greatest(size, F.lit(1)).cast("double") - F.lit(6.0)) / F.lit(6.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target from sizes(source, source_size); one row per source, so its windows stay small."""
    named = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = reduce(lambda c, i: c.when(F.col("__rank") % len(weights) == i, F.lit(weights[i])), range(1, len(weights)), F.when(F.col("__rank") % len(weights) == 0, F.lit(weights[0])))
    named = named.withColumn("__weight", weight).withColumn("__limit", F.lit(cap) * F.col("source_size"))
    # sources reach their limits in the order of limit / weight; level: what a unit of weight gets if those before it have reached theirs
    order = Window.orderBy(F.col("__limit") / F.col("__weight"), "__rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (whole - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("__weight").over(after)
    named = named.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col("__weight") >= F.col("__limit"))
    final = F.min(F.when(~F.col("__full"), F.struct(F.col("__limit") / F.col("__weight"), "__rank", "__level"))).over(Window.partitionBy()).getField("__level")
    target = F.when(F.col("__full"), F.col("__limit")).otherwise(F.least(final * F.col("__weight"), F.col("__limit")))
    return named.select("source", "source_size", target.alias("target"))


def _border(sums: DataFrame, goals: DataFrame, place: str, below: str) -> DataFrame:
    """The goals with ``place`` (that of sums(source, place, n) in which the rest of the target ends, beyond the last
    one if none, -1 if nothing is left to give) and what lies before it, counted on from goals' column ``before``."""
    up_to = F.sum("n").over(Window.partitionBy("source").orderBy(place))
    ends = sums.withColumn("end", up_to).withColumnRenamed("source", "__s").join(goals.select("source", "rest", "before"), F.col("__s").eqNullSafe(F.col("source")))
    ends = ends.where("before + end - n <= rest and before + end > rest")
    found = ends.groupBy(F.col("source").alias("__s")).agg(F.min(place).alias("__at"), F.min(F.col("before") + F.col("end") - F.col("n")).alias(below))
    joined = goals.join(found, F.col("__s").eqNullSafe(F.col("source")), "left").drop("__s")
    return joined.withColumn(place, F.coalesce("__at", F.when(F.col("rest") > 0, F.lit(1 << 30)).otherwise(F.lit(-1)))).drop("__at")


def _planned(docs: DataFrame, work: Workspace, weights: tuple[float, ...], share: float, cap: float, bins: int, seed: str, weight: str | None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    text = F.col("text").cast("string")
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        text_size(text).alias("size"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"),
        (F.lit(None) if weight is None else quoted(weight)).cast("double").alias("weight"),
    )
    worth = quality(F.col("chars"), F.col("size")) if weight is None else F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-12))
    key = -F.log(draw(F.col("doc_id"), seed)) / worth
    sized = sized.withColumn("key", key).withColumn("place", F.lit(bins / (2 * LOGS)) * (F.least(F.greatest(F.log("key"), F.lit(-LOGS)), F.lit(LOGS)) + F.lit(LOGS)))
    sized = sized.withColumn("bin", F.floor("place").cast("int")).withColumn("part", F.floor((F.col("place") - F.col("bin")) * FINE).cast("int"))
    sized = work.keep(sized.select("doc_id", "source", "size", "key", "bin", "part"), "sized")
    per_bin = work.keep(sized.groupBy("source", "bin").agg(F.sum("size").alias("n")), "bins")
    goals = source_targets(per_bin.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("before", F.lit(0).cast("long"))
    goals = _border(per_bin, work.keep(goals, "goals"), "bin", "below")
    goals = work.keep(goals.drop("before").withColumnRenamed("bin", "__bin"), "borders")
    few = goals.count() <= SENT_SOURCES

    def beside(columns: list[str]) -> DataFrame:
        known = goals.select(F.col("source").alias("__s"), *columns)
        return sized.join(F.broadcast(known) if few else known, F.col("__s").eqNullSafe(F.col("source"))).drop("__s")

    per_part = beside(["__bin"]).where("bin = __bin").groupBy("source", "part").agg(F.sum("size").alias("n"))
    goals = _border(per_part, goals.withColumnRenamed("below", "before"), "part", "below")
    goals = work.keep(goals.withColumnRenamed("part", "__part"), "parts")
    placed = beside(["source_size", "target", "epochs", "rest", "__bin", "__part", "below"])
    columns = ["doc_id", "source", "size", "source_size", "target"]
    first = (F.col("bin") < F.col("__bin")) | ((F.col("bin") == F.col("__bin")) & (F.col("part") < F.col("__part")))
    at_border = (F.col("bin") == F.col("__bin")) & (F.col("part") == F.col("__part"))
    clear = placed.where(~at_border).select(*columns, ((F.col("epochs") + F.when(first, 1).otherwise(0)) * F.col("size")).alias("taken"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.where(at_border).withColumn("end", F.col("below") + F.sum("size").over(order))
    nearer = F.col("end") - F.col("rest") <= F.col("rest") - (F.col("end") - F.col("size"))
    more = F.when((F.col("end") <= F.col("rest")) | ((F.col("end") - F.col("size") < F.col("rest")) & nearer), 1).otherwise(0)
    edge = at.select(*columns, ((F.col("epochs") + more) * F.col("size")).alias("taken"))
    return clear.union(edge)


def mix_plan(
    docs: DataFrame, work: Workspace, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, bins: int = BINS, seed: str = SEED, weight: str | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source); ``weight`` names a column of quality weights."""
    return _planned(docs, work, weights, share, cap, bins, seed, weight).drop("source")


def mixed_documents(docs: DataFrame, work: Workspace, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, weight: str | None = None) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns as they were. Documents without words stay out.

    Rows that share a doc_id are told apart only where the border runs between them: those of one id, source and size
    are then numbered on both sides, so that as many of them come as the plan takes.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    size, times = (F.col("taken") / F.greatest("size", F.lit(1))).cast("int"), F.col("times")
    plan = work.keep(_planned(docs, work, weights, share, cap, BINS, SEED, weight).select(F.col("doc_id").alias("id"), F.col("source").alias("src"), "size", size.alias("times")), "plan")
    rows = docs.select(*(quoted(c).alias(p) for c, p in zip(names, plain, strict=True)), F.col("doc_id").alias("doc"), F.col("source").cast("string").alias("origin"), F.col("text").cast("string").alias("whole"))
    rows = rows.where(F.col("whole").rlike(WORD))
    by_id = plan.where("size > 0").groupBy("id").agg(F.min("times").alias("low"), F.max("times").alias("times"))
    like = F.col("doc").eqNullSafe(F.col("id"))
    alike = rows.join(by_id.where("low = times and times > 0"), like).select(*plain, "times")
    torn = work.keep(by_id.where("low < times").select("id"), "torn")
    some = rows.join(F.broadcast(torn) if torn.count() <= SENT_SOURCES else torn, like, "left_semi").withColumn("words", text_size(F.col("whole")))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("doc", "origin", "words").orderBy(F.monotonically_increasing_id())))
    dealt = plan.join(torn.withColumnRenamed("id", "torn"), F.col("id").eqNullSafe(F.col("torn")), "left_semi")
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("id", "src", "size").orderBy(F.desc("times"))))
    again = some.join(dealt.where("times > 0"), like & F.col("origin").eqNullSafe(F.col("src")) & (F.col("words") == F.col("size")) & (F.col("k") == F.col("rank"))).select(*plain, "times")
    every = alike.union(again)
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*plain).toDF(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), Workspace(spark, "mixing"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars FROM documents),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
             / (1::DOUBLE / (1::DOUBLE + abs(chars::DOUBLE / greatest(size, 1)::DOUBLE - 6::DOUBLE) / 6::DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS wt, 2::DOUBLE * source_size AS lim FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / wt, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(wt) OVER (ORDER BY lim / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, lev * wt >= lim AS full_ FROM l),
x AS (SELECT lev FROM f WHERE NOT full_ ORDER BY lim / wt, rk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN full_ THEN lim ELSE least((SELECT lev FROM x) * wt, lim) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS ep FROM t),
o AS (SELECT k.doc_id, size, source_size, target, ep, target - ep * source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS en
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST((ep + CASE WHEN en <= rest OR (en - size < rest AND en - rest <= rest - (en - size)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""
