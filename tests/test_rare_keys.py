"""Alike names by keys of several rare shingles: no pair is lost, few others meet."""

import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import resolve
from factgraph.plans.lineage import Lineage


def met(sets, least):
    keys = resolve._rarest(sets, "uuid", resolve._shingle_counts(sets), least)
    rows = keys.select(F.col("uuid").alias("a"), "t").join(keys.select(F.col("uuid").alias("b"), "t"), "t").where("a < b")
    return {(r.a, r.b) for r in rows.select("a", "b").distinct().collect()}


@pytest.mark.parametrize(("least", "triples", "couples"), [(0.9, 64, 160), (0.9, 12, 20), (0.75, 6, 9), (0.5, 64, 160)])
def test_no_alike_pair_is_lost(spark, monkeypatch, least, triples, couples):
    monkeypatch.setattr(resolve, "TRIPLES", triples)
    monkeypatch.setattr(resolve, "COUPLES", couples)
    pick, rows = random.Random(5), []
    for i in range(60):
        base = pick.sample(range(60), pick.randint(1, 30))
        rows += [(f"u{i:02d}{k}", sorted({*base} - {*pick.sample(base, min(k, len(base) - 1))} | {*pick.sample(range(60), k // 2)})) for k in range(4)]
    sets = spark.createDataFrame(rows, "uuid string, shingles array<bigint>")
    alike = {(a, b) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) >= least * len({*x, *y})}
    assert len(alike) > 20
    assert alike <= met(sets, least)


def test_numbered_names_meet_few(spark):
    names = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") + 10000).alias("uuid"), F.concat(F.lit("Unknown thing number "), F.col("id") * 4 + 10000).alias("name"))
    sets = resolve.signed(names).select("uuid", F.transform("shingles", lambda x: F.xxhash64(x)).alias("shingles"))
    assert len(met(sets, 0.9)) < 20 * 3000
    assert resolve.dedupe_batch(names.limit(200), Lineage(spark)).count() == 200


def test_copies_follow_the_first_of_their_name(spark):
    rows = [("b", "Red Rings"), ("a", "red  ring"), ("c", "RED RINGS"), ("n", None), ("o", None), ("d", "green bolt"), ("c", "green bolt"), ("e", "alone")]
    got = resolve.dedupe_batch(spark.createDataFrame(rows, "uuid string, name string"), Lineage(spark))
    assert {(r.uuid, r.canonical) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("n", "n"), ("o", "o"), ("e", "e")}


def test_only_alike_names_are_signed(spark, monkeypatch):
    seen, signed = [], resolve.signed
    monkeypatch.setattr(resolve, "signed", lambda names, *rest: seen.append(names.count()) or signed(names, *rest))
    number = F.md5(F.col("id").cast("string").cast("binary"))
    old = spark.range(50).select(F.concat(F.lit("o"), "id").alias("uuid"), number.alias("name")).unionByName(spark.createDataFrame([("ox", "international crisis committee of europe")], "uuid string, name string"))
    new = spark.range(100, 150).select(F.concat(F.lit("n"), "id").alias("uuid"), number.alias("name")).unionByName(spark.createDataFrame([("nx", "international crisis committee of europa")], "uuid string, name string"))
    found = {(r.uuid, r.canonical, r.reason) for r in resolve.resolve(new, old, 0.8).collect()}
    assert found == {("nx", "ox", "fuzzy")}
    assert sum(seen) == 2
