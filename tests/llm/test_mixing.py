import pytest

from factgraph.llm import mixing
from factgraph.llm.common import Workspace


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Shares by weight, the excess of full sources dealt again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: cap * sizes[s] for s in order}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= limit[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = limit[s]
            left -= limit[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 300, "c": 50, None: 70}, {"a": 10}, {"a": 1, "b": 1000, "c": 1000, "d": 5, "e": 0}, {"é": 10, "z": 10, "Z": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_plan(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), ["a", "b", None][i % 3]) for i in range(900)] + [(1000, None, "a"), (1001, "", "b"), (None, "x y", "b"), (5, "dup row", "a"), (5, "dup row", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    once = sorted(map(tuple, mixing.mix_plan(df, Workspace(spark, "t")).collect()), key=repr)
    again = sorted(map(tuple, mixing.mix_plan(df.repartition(7), Workspace(spark, "t"), bins=4).collect()), key=repr)
    assert len(once) == len(rows) and [r[:4] for r in once] == [r[:4] for r in again]
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in once)
    for target in {r[3] for r in once}:
        mine = [r for r in once if r[3] == target]
        assert abs(sum(r[4] for r in mine) - target) <= max(r[1] for r in mine)


def test_bins_do_not_change_the_choice(spark):
    df = spark.createDataFrame([(i, " ".join(["ab"] * (i % 30 + 1)), "s" + str(i % 5)) for i in range(600)], "doc_id long, text string, source string")
    plans = [sorted(map(tuple, mixing.mix_plan(df, Workspace(spark, "t"), bins=b).collect())) for b in (1, 64, 4096)]
    assert plans[0] == plans[1] == plans[2]


def test_documents_repeat(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y"), (3, None, "y")], "doc_id long, text string, source string")
    plan = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix_plan(df, Workspace(spark, "t")).collect()}
    got = [r.doc_id for r in mixing.mixed_documents(df, Workspace(spark, "t")).collect()]
    assert {i: got.count(i) for i in (1, 2, 3)} == plan
    assert mixing.mix_plan(df.limit(0), Workspace(spark, "t")).count() == 0
