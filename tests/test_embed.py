"""Texts are embedded once; prefixes lose no pair; encoders are handed in; parallel forms of small reports."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factgraph.operators import canon, embed, report, search
from factgraph.plans.lineage import Lineage


def test_a_second_run_makes_no_call(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(texts):
        with open(calls, "a") as f:
            f.writelines(f"{len(t)}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    cache = embed.EmbeddingCache(spark, str(tmp_path / "cache"), "m", model, 2)
    rows = spark.createDataFrame([(1, "a", 0), (2, "bbb", 0), (3, "a", 0), (4, None, 0), (5, "", 0)], "id int, text string, v int")
    got = {r.id: r.v for r in cache.embedded(rows, "text", "v").collect()}
    assert got == {1: [1.0, 1.0], 2: [3.0, 1.0], 3: [1.0, 1.0], 4: None, 5: [0.0, 1.0]} and sorted(calls.read_text().split()) == ["0", "1", "3"]
    more = rows.union(spark.createDataFrame([(6, "cc", 0)], rows.schema))
    assert cache.embedded(more, "text", "v").where("v is not null").count() == 5 and sorted(calls.read_text().split()) == ["0", "1", "2", "3"]
    assert cache.embedded(more, "text", "v").count() == 6 and len(calls.read_text().split()) == 4
    other = embed.EmbeddingCache(spark, cache.path, "another", lambda texts: [])
    with pytest.raises(Exception, match="0 vectors for"):
        other.embedded(rows, "text", "v").count()
    assert cache.embedded(rows.limit(0), "text", "v").count() == 0


def plain_tfidf(names, least):
    grams = {n: Counter(n.lower()[i : i + k] for k in (3, 4, 5) for i in range(len(n) - k + 1)) for n in names}
    df = Counter(g for c in grams.values() for g in c)
    vectors = {}
    for n, c in grams.items():
        w = {g: t * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, t in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        vectors[n] = {g: x / size for g, x in w.items()} if size else {}
    out = {}
    for a in names:
        for b in names:
            if a < b and (s := sum(x * vectors[b].get(g, 0) for g, x in vectors[a].items())) >= least:
                out[a, b] = round(s, 9)
    return out


@pytest.mark.parametrize("least", [0.1, 0.3, 0.8])
def test_prefixes_lose_no_pair(spark, least):
    rng = random.Random(3)
    names = sorted({"IS_" + "_".join(rng.choices(["PART", "OF", "LOCATED", "IN", "NEAR", "OWNED", "BY", "AB"], k=rng.randrange(1, 5))) for _ in range(90)} | {"AB", "x"})
    got = {(r.a, r.b): round(r.similarity, 9) for r in canon.tfidf_pairs(spark.createDataFrame([(n,) for n in names], "name string"), least, lineage=Lineage(spark)).collect()}
    want = plain_tfidf(names, least)
    border = {k for k in got.keys() ^ want.keys() if abs((got.get(k) or want.get(k)) - least) > 1e-9}
    assert not border and all(abs(got[k] - want[k]) < 1e-8 for k in got.keys() & want.keys()) and len(want) > 5


def test_an_encoder_is_handed_in(spark):
    rows = spark.createDataFrame([("1", "short"), ("2", "a longer passage"), ("3", "short")], "uuid string, name string")
    by_length = lambda query, passage: F.length(passage) - len(query)
    assert {r.uuid: r.score for r in search.cross_encoded(rows, "abc", "name", encoder=by_length).collect()} == {"3": 2.0, "2": 13.0}
    around = search.Surroundings(encoder=by_length)
    found = search.hybrid(rows, "short passage", None, ["name"], None, search.Recipe(("bm25",), "cross_encoder"), "communities", around)
    assert [r.uuid for r in found.collect()] == ["2"]


def test_distribution_and_entropy(spark):
    rng = random.Random(1)
    values = [rng.randrange(20) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = {r.value: (r.n, round(r.cdf, 9)) for r in report.cdf(df, "x").collect()}
    assert got == {v: (values.count(v), round(sum(x <= v for x in values) / 300, 9)) for v in set(values)}
    sizes = spark.createDataFrame([(3,), (1,), (4,)], "total_count int")
    p = [3 / 8, 1 / 8, 4 / 8]
    bits = -sum(x * math.log2(x) for x in p)
    r = report.entropy(sizes).first()
    assert (round(r.bits, 9), round(r.normalized, 9)) == (round(bits, 9), round(bits / math.log2(3), 9))
    assert report.entropy(sizes.limit(1)).first().normalized == 0.0
