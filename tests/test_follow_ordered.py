"""Pairs worked off in order, against the same done one by one."""

import random

import pytest

from factgraph.operators import graph
from factgraph.plans.lineage import Lineage


def one_by_one(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in sorted(pairs):
        a, b = root(a), root(b)
        parent[a] = b
    return {x: root(x) for x in list(parent)}


def same(spark, pairs):
    rows = graph.follow_ordered(spark.createDataFrame(pairs, "ord int, a string, b string"), Lineage(spark)).collect()
    assert len(rows) == len({r.uuid for r in rows}) and {r.uuid: r.canonical for r in rows} == one_by_one(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_random_pairs_with_ties_repeats_and_circles(spark, seed):
    rng = random.Random(seed)
    same(spark, [(rng.randrange(60), f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range(rng.choice([40, 70, 160]))] * (1 + seed % 2))


def test_paths_up_down_and_mixed(spark):
    n = 200
    rng = random.Random(7)
    shuffled = rng.sample(range(n), n)
    same(
        spark,
        [(i, f"u{i:03d}", f"u{i + 1:03d}") for i in range(n)]
        + [(n - i, f"d{i:03d}", f"d{i + 1:03d}") for i in range(n)]
        + [(shuffled[i], *((f"m{i:03d}", f"m{i + 1:03d}") if i % 3 else (f"m{i + 1:03d}", f"m{i:03d}"))) for i in range(n)],
    )


def test_hubs_that_meet_late(spark):
    rng = random.Random(9)
    hubs = [(rng.randrange(1000), *rng.sample([f"h{k}", f"x{k}-{i}"], 2)) for k in range(5) for i in range(60)]
    same(spark, hubs + [(rng.randrange(1000), f"x{k}-{rng.randrange(60)}", f"x{k + 1}-{rng.randrange(60)}") for k in range(4)])


def test_edges(spark):
    assert graph.follow_ordered(spark.createDataFrame([], "ord int, a string, b string"), Lineage(spark)).count() == 0
    some = spark.createDataFrame([(1, "a", "a"), (2, "b", None), (3, None, "c"), (4, "d", "e"), (5, "e", "d")], "ord int, a string, b string")
    assert {r.uuid: r.canonical for r in graph.follow_ordered(some, Lineage(spark)).collect()} == {"a": "a", "d": "e", "e": "e"}
