import random

import numpy as np
import pytest

from factgraph.llm import jaccard_join as jj
from factgraph.llm.common import Workspace, connected_components


def brute(rows, words, num, den):
    sets, sizes = {}, {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w)) or 1
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        sizes[doc] = len(sets[doc])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (sizes[d], find(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (5, "  one\ttwo\n")]
    base = [rng.choices(vocabulary, k=n) for n in (8, 9, 10, 11, 40, 60, 120, 300)]
    for b in base:
        for _ in range(9):
            w = list(b)
            for _ in range(rng.randrange(0, max(2, len(w) // 30 + 1))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(0, max(1, len(w) // 12))]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(rng.choices(vocabulary, k=20) + passage)) for i in range(20)]
    return rows


@pytest.mark.parametrize(("seed", "words", "num"), [(1, 3, 90), (2, 5, 80), (3, 3, 80), (4, 2, 70)])
def test_groups_equal_brute_force(spark, seed, words, num):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_groups(df, Workspace(spark, "t"), words, num, 100).collect()}
    assert got == brute(rows, words, num, 100)


@pytest.mark.parametrize("held", [20_000, 10])
def test_large_keys(spark, monkeypatch, held):
    """More near copies than SMALL, of which few are linked to the first one, in gathered keys and in keys that are not."""
    monkeypatch.setattr(jj, "HELD", held)
    rng = random.Random(7)
    b = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        w = list(b)
        for k in rng.sample(range(100), rng.randrange(0, 4)):
            w[k] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_groups(df, Workspace(spark, "t"), 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_overlaps():
    rng = np.random.default_rng(0)
    one = [np.unique(rng.integers(0, 60, 20).astype(np.uint64)) for _ in range(5)]
    two = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(4)]
    assert jj.overlaps(one, two, 7).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_groups(df, Workspace(spark, "t"), 3, 90, 100).collect()), key=repr)
    assert got == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None)]
    assert jj.jaccard_groups(df.limit(0), Workspace(spark, "t")).count() == 0
    kept = jj.one_of_each_group(df, Workspace(spark, "t"), 3, 90, 100).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [5, 5, None]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
