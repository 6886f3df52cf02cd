"""Likest nodes by full text where some words are common, against the plain form."""

import math
import random
from collections import Counter

import pytest

from factgraph.operators import search


def plain(rows, limit):
    out = set()
    for g in {r[1] for r in rows}:
        docs = {u: Counter(t.split()) for u, h, t in rows if h == g}
        n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
        df = Counter(w for d in docs.values() for w in d)
        for q, words in docs.items():
            found = []
            for u, d in docs.items():
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for w in words if w in d)
                if u != q and s:
                    found.append((-round(s, 9), u))
            out |= {(q, u, round(-s, 6)) for s, u in sorted(found)[:limit]}
    return out


@pytest.mark.parametrize("common", [0, 6, 1000])
def test_common_words_lose_nothing(spark, monkeypatch, common):
    monkeypatch.setattr(search, "COMMON", common)
    pick = random.Random(3)
    words = ["all", "most", "some"] + [f"w{i}" for i in range(40)]
    rows = [(f"u{i:03d}", f"g{i % 2}", " ".join(w for w in words[:3] * 2 + pick.sample(words[3:], pick.randint(0, 2)) if w[0] == "w" or pick.random() < 0.5)) for i in range(120)]
    rows += [("empty", "g0", ""), ("alone", "g1", "nobody")]
    df = spark.createDataFrame(rows, "uuid string, group_id string, name string")
    got = {(r.query_uuid, r.uuid, round(r.score, 6)) for r in search.relevant_by_text(df, df, "name", 4).collect()}
    assert got == plain(rows, 4)


def test_a_word_of_all_nodes_makes_no_row_for_each_pair(spark, monkeypatch):
    """3,000 nodes with one word in common: a row for each pair would be nine million."""
    seen, best = [], search.best
    monkeypatch.setattr(search, "best", lambda rows, *rest: seen.append(rows.count()) or best(rows, *rest))
    df = spark.createDataFrame([(f"u{i:04d}", "g", f"customer {i}") for i in range(3000)], "uuid string, group_id string, name string")
    got = search.relevant_by_text(df, df, "name", 2).collect()
    assert {r.uuid for r in got if r.query_uuid > "u0001"} == {"u0000", "u0001"} and len(got) == 6000
    assert max(seen) < 20_000
