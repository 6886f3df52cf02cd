"""Alike names by rare shingles, held against all candidate pairs."""

import random

from pyspark.sql import functions as F

from factgraph.operators import resolve
from factgraph.plans.lineage import Lineage


def names(spark):
    draw = random.Random(5)
    words = ["steel", "green", "polished", "brass", "economy", "burnished", "almond", "tomato"]
    rows = [" ".join(draw.choices(words, k=4)) for _ in range(120)]
    rows += [r[:i] + "q" + r[i + 1 :] for r in rows[:40] for i in (2, len(r) - 2)] + ["ab", "", "aaaa", "Éclair au chocolat noir", "Éclair au chocolat noirs", None]
    return spark.createDataFrame([(f"n{i:03}", r) for i, r in enumerate(rows)], "uuid string, name string")


def test_pairs_by_rare_shingles_are_those_of_the_bands(spark):
    every = resolve.jaccard_pairs(names(spark))
    whole = {(r.a, r.b): r.score for r in every.collect()}
    for least in (0.5, 0.8, 0.9, 1.0):
        found = {(r.a, r.b): r.score for r in resolve.jaccard_pairs(names(spark), least, Lineage(spark)).collect()}
        assert found == {k: v for k, v in whole.items() if v >= least} and found


def test_many_copies_of_a_name_resolve_alike(spark):
    known = spark.createDataFrame([("k2", "polished steel almonds"), ("k1", "green tomato brass")], "uuid string, name string")
    new = spark.range(500).select(F.concat(F.lit("x"), "id").alias("uuid"), F.lit("polished steel almonda").alias("name"))
    rows = resolve.resolve(new, known, 0.8).collect()
    assert len(rows) == 500 and {(r.canonical, r.reason) for r in rows} == {("k2", "fuzzy")}
    assert resolve.resolve(new.limit(0), known).count() == 0 and resolve.resolve(new, known.limit(0)).count() == 0
