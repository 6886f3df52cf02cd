"""Label propagation against a brute-force version, on long paths and on the links of all orders."""

import os

import duckdb
import pytest

from factgraph.operators import graph
from factgraph.plans.lineage import Lineage
from factgraph.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(pairs):
    weight = {}
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                weight.setdefault(x, {}).setdefault(y, 0)
                weight[x][y] += 1
    now, before, seen = {x: x for x in weight}, {x: None for x in weight}, []
    while True:
        new = {}
        for x, near in weight.items():
            votes = {}
            for y, w in near.items():
                votes[now[y]] = votes.get(now[y], 0) + w
            w, c = max((w, c) for c, w in votes.items())
            new[x] = c if w > 1 else max(c, now[x])
            if new[x] == before[x] and new[x] != now[x]:
                new[x] = min(new[x], now[x])
        now, before = new, now
        if now == before or (now, before) in seen:
            return now
        seen.append((now, before))


def test_labels_cross_a_long_path(spark):
    names = [f"n{i:02}" for i in range(26)]
    pairs = list(zip(names, names[1:], strict=False))
    links = graph.neighbours(spark.createDataFrame(pairs, "source_node_uuid string, target_node_uuid string"))
    got = {r.uuid: r.community for r in graph.label_propagation(links, Lineage(spark)).collect()}
    assert got == dict.fromkeys(names, "n25") == brute(pairs)


def test_labels_raise_at_the_guard(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d")]
    links = graph.neighbours(spark.createDataFrame(pairs, "source_node_uuid string, target_node_uuid string"))
    with pytest.raises(RuntimeError):
        graph.label_propagation(links, Lineage(spark), rounds=2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_query_takes_all_orders(spark):
    pairs = duckdb.sql(f"SELECT 'c' || o_custkey, 'c' || ((o_custkey * 3 + o_orderkey) % 1500) FROM '{SF}/orders.parquet'").fetchall()
    assert {r.uuid: r.community for r in QUERIES["label_propagation"](spark, SF).collect()} == brute(pairs)
