"""Line bitmaps against brute force: any partitioning, hot lines across tasks, and the odd rows."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import line_dedup
from factgraph.llm.common import Workspace

WS = "\t\n\v\f\r "


def brute(rows, least, chars=1, spare_first=False):
    """(doc_id, n_lines, n_dropped, kept text) of each row."""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(WS))
    texts = [(t or "").split("\n") for _, t in rows]
    where = defaultdict(list)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        for line, text in enumerate(texts[i]):
            if len(key(text)) >= chars:
                where[key(text)].append((i, line))
    gone = set()
    for places in where.values():
        if len({i for i, _ in places}) >= least:
            gone.update(places[1:] if spare_first else places)
    return [(d, len(texts[i]), sum(g[0] == i for g in gone), "\n".join(x for j, x in enumerate(texts[i]) if (i, j) not in gone)) for i, (d, _) in enumerate(rows)]


def computed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id int, text string, keep string, `PLACES` int")
    work = Workspace(spark, "t")
    documents = line_dedup.numbered(df, work)
    bitmaps = line_dedup.line_bitmaps(documents, work, **options)
    changed = {r.doc: r.kept for r in line_dedup.kept_text(documents, bitmaps).collect()}
    texts = {r.doc: r.text for r in documents.collect()}
    return [(r.doc_id, r.n_lines, r.n_dropped, changed.get(r.doc, texts[r.doc])) for r in sorted(bitmaps.collect(), key=lambda r: r.doc)]


def odd_rows():
    rng = random.Random(7)
    hot = ["Share this", "  share THIS\t", "© All rights", "É", "é", "", " \t", "x"]
    rows = [(i % 37 if i % 11 else None, "\n".join(rng.choices([*hot, *(f"line {k}" for k in range(60))], [9, 9, 5, 3, 3, 9, 3, 3, *[1] * 60], k=rng.randrange(0, 12)))) for i in range(160)]
    return [*rows, (3, None), (3, ""), (4, "\n"), (4, "\n\n"), (5, "Share this\n" * 300 + "end"), rows[0], rows[0], (6, "\r\nx\r"), (7, "a\x85b c")]


@pytest.mark.parametrize("options", [{"docs_at_least": 10}, {"docs_at_least": 2, "chars": 3}, {"docs_at_least": 1, "spare_first": True}, {"docs_at_least": 5, "spare_first": True}])
@pytest.mark.parametrize("partitions", [1, 23])
def test_against_brute_force(spark, options, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = brute(odd_rows(), options["docs_at_least"], options.get("chars", 1), options.get("spare_first", False))
        assert computed(spark, odd_rows(), **options) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_a_very_long_text(spark):
    assert computed(spark, [], docs_at_least=2) == []
    rows = [(1, "\n".join(f"l{i}" for i in range(200_000))), (2, "\n".join(f"l{i}" for i in range(0, 200_000, 2)))]
    (_, n, lost, kept), (_, _, all_, rest) = computed(spark, rows, docs_at_least=2)
    assert (n, lost, all_, rest) == (200_000, 100_000, 100_000, "") and kept.split("\n")[:2] == ["l1", "l3"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=60, unique=True), st.integers(1, 5), st.booleans(), st.lists(st.integers(1, 9), min_size=1, max_size=30), st.integers(1, 7))
def test_a_stream_cut_anywhere_drops_the_same(rows, least, spare_first, tasks, batch):
    """The stream by itself: rows of (key, doc) over tasks of any sizes, in batches of any size."""
    import pyarrow as pa

    rows = sorted(rows)
    made, at, task = [], 0, 0
    while at < len(rows):
        part = rows[at : at + tasks[task % len(tasks)]]
        at += len(part)
        columns = [pa.array([k for k, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([d for _, d in part], pa.int64()), pa.array([d for _, d in part], pa.int64()), pa.array([[0, 1]] * len(part), pa.list_(pa.int32()))]
        whole = pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "doc_id", "doc", "places"])
        cut = [whole.slice(i, batch) for i in range(0, len(part), batch)]
        got = [r for b in line_dedup._stream(least, spare_first)(cut) for r in b.to_pylist()]
        assert sum(r["kind"] == line_dedup.OPEN for r in got) <= 2 * least
        made += [r | {"task": task} for r in got]
        task += 1
    total, first = defaultdict(int), {}
    for r in made:
        if r["kind"] == line_dedup.COUNT:
            total[r["hi"]] += r["n"]
            first.setdefault(r["hi"], r["task"])
    dropped = [(r["doc"], p) for r in made if r["kind"] == line_dedup.DROPPED for p in r["places"]]
    for r in made:
        if r["kind"] == line_dedup.OPEN and total[r["hi"]] >= least:
            spared = spare_first and r["lead"] and r["task"] == first[r["hi"]]
            dropped += [(r["doc"], p) for p in (r["places"][1:] if spared else r["places"])]
    want = []
    for k in {k for k, _ in rows}:
        docs = [d for x, d in rows if x == k]
        if len(docs) >= least:
            want += [(d, p) for i, d in enumerate(docs) for p in ([1] if spare_first and not i else [0, 1])]
    assert sorted(dropped) == sorted(want)


@given(st.integers(1, 3000), st.sets(st.integers(0, 2999)))
@settings(max_examples=60, deadline=None)
def test_bitmaps_come_back(n, lost):
    lost = sorted(x for x in lost if x < n)
    kept = line_dedup.kept_lines(n, line_dedup._bitmap(n, lost))
    assert [i for i in range(n) if not kept[i]] == lost
