import random

import numpy as np
import pytest

from factgraph.llm import decontaminate as dc
from factgraph.llm import windows


def brute(text, items, window):
    w = dc.words(text)
    hit, found = set(), set()
    for name, item in items:
        t = dc.words(item)
        n = min(window, len(t))
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "c", "d"]
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 12])))) for i in range(8)] + [(99, "")]
    machine = dc.SuffixAutomaton([(n, dc.words(t)) for n, t in items if t], 5)
    for _ in range(60):
        text = " ".join(rng.choices([*letters, "z"], k=rng.randrange(0, 40)))
        spans, found = machine.scan(dc.words(text))
        assert (len(dc.words(text)), sum(b - a for a, b in spans), sorted(str(machine.names[k]) for k in found)) == brute(text, items, 5)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_words_keep_letters_of_other_alphabets():
    assert dc.words("Ünï-CODE 12x_É") == ["Ünï".encode(), b"code", b"12x", "É".encode()]


def test_query_edges(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "start " + passage + " end"), (2, None), (3, ""), (4, "clean text"), (5, "short item"), (5, "short item"), (6, "x " * 400 + passage)], "doc_id long, text string")
    items = spark.createDataFrame([(10, passage), (9, passage), (8, "Short, item!"), (7, None), (6, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in dc.contamination(docs, items).collect())
    assert got == [(1, 22, 20, ["10", "9"]), (2, 0, 0, []), (3, 0, 0, []), (4, 2, 0, []), (5, 2, 2, ["8"]), (5, 2, 2, ["8"]), (6, 420, 20, ["10", "9"])]
    assert sorted(r.doc_id for r in dc.clean_documents(docs, items).collect()) == [2, 3, 4, 6]
    cut = {r.doc_id: r.text for r in dc.remove_passages(docs, items).collect()}
    assert cut[1] == "start  end" and cut[2] is None and cut[4] == "clean text" and "q3" not in cut[6]
    assert dc.contamination(docs.limit(0), items).count() == 0 and dc.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "s", 9), (2, "z", 8, "t", 9)], "doc_id long, text string, n_hit int, hit_spans string, `N_WORDS` int")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (dc.clean_documents(docs, items), dc.remove_passages(docs, items)):
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert [tuple(r) for r in dc.clean_documents(docs, items).collect()] == [(2, "z", 8, "t", 9)]
    assert sorted(tuple(r) for r in dc.remove_passages(docs, items).collect()) == [(1, "", 7, "s", 9), (2, "z", 8, "t", 9)]
    got = dc.contamination(docs, items, keep=["doc_id", "n_hit"])
    assert got.columns == ["doc_id", "n_words", "n_hit", "hit_spans", "hit_items"] and {r.doc_id: r.n_hit for r in got.collect()} == {1: 3, 2: 0}


def test_item_without_an_id_hits_but_has_no_name(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b"), (4, "a")], "item_id long, text string")
    row = dc.contamination(docs, items).first()
    assert (row.n_hit, row.hit_items) == (2, ["4"])


def test_many_groups_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    letters = ["a", "b", "c", "d", "e"]
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 3, 5, 14, 20])))) for i in range(30)] + [(31, None)]
    docs = [(i, " ".join(rng.choices(letters, k=rng.randrange(0, 40)))) for i in range(30)] + [(40, None), (None, "a b c"), (None, "a b c")]
    one, two = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, dc.contamination(one, two, 4).collect()))
    monkeypatch.setattr(dc, "ITEMS_BYTES", 100)
    assert len(list(dc.item_groups(two))) > 3
    assert sorted(map(str, dc.contamination(one, two, 4).collect())) == want
    for row in dc.contamination(one, two, 4).where("doc_id is not null").collect():
        assert (row.n_words, row.n_hit, row.hit_items) == brute(dict(docs)[row.doc_id], [(n, t) for n, t in items if t], 4)


def test_a_very_long_document():
    item = [f"q{i}" for i in range(40)]
    machine = dc.SuffixAutomaton([(1, dc.words(" ".join(item)))], 13)
    text = ("x " * 100_000 + " ".join(item) + " ") * 3
    spans, found = machine.scan(dc.words(text))
    assert [b - a for a, b in spans] == [40] * 3 and found == {0}


def test_hashes_of_windows_do_not_hang_on_their_place():
    rng = random.Random(3)
    for n in (1, 2, 5):
        text = " ".join(rng.choice(["a", "bb", "ccc", "é"]) for _ in range(400)).encode()
        starts, ends = windows.bounds(text)
        grams = [text[starts[i] : ends[i + n - 1]] for i in range(len(starts) - n + 1)]
        got = windows.hashes(text, starts, ends, n)
        assert len({(g, h) for g, h in zip(grams, got.tolist(), strict=True)}) == len(set(grams)) == len(set(got.tolist()))
        assert (windows.hashes(text, starts[7:60], ends[7:60], n) == got[7 : 60 - n + 1]).all()
    assert len(windows.hashes(b"", *windows.bounds(b""), 1)) == 0


@pytest.mark.parametrize("most", [1, 9, 40, 10_000])
def test_stretches_have_every_window_once_and_none_too_short(most):
    text = b" ".join(b"w" * (1 + i % 7) for i in range(90))
    starts, ends = windows.bounds(text)
    parts = list(windows.stretches(starts, ends, most, 5))
    assert [i for a, b in parts for i in range(a, b - 4)] == list(range(86))
    assert parts[-1][1] == 90 and all(b - a >= 5 for a, b in parts)


def test_an_item_above_the_bound_is_cut_and_found_whole(spark, monkeypatch):
    rng = random.Random(8)
    passage = [f"v{rng.randrange(10**6)}" for _ in range(600)]
    items = [(1, " ".join(passage)), (2, "one two three"), (3, " ".join(passage[250:270])), (None, "lonely"), (4, " ".join(passage)), (4, " ".join(passage))]
    docs = [(i, " ".join([*["pad"] * i, *passage[i * 40 : i * 40 + 90], "one two", "three", "lonely" if i == 3 else "x"])) for i in range(14)]
    docs += [(20, " ".join(passage) * 1), (20, " ".join(passage) * 1), (21, None), (22, "the pad"), (23, " ".join(passage[:12]))]
    one, two = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "ITEMS_BYTES", 500)
    monkeypatch.setattr(dc, "RUNS_BYTES", 2000)
    parts = dc.grouped_items(two, 13).collect()
    assert len({r.part for r in parts}) > 5 and all(len(r.words) <= 500 for r in parts)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in dc.contamination(one, two).collect())
    named = [(n, t) for n, t in items if n is not None]
    want = []
    for i, text in docs:
        total, hits, found = brute(text, named, 13)
        want.append((i, total, hits + (i == 3), found))
    assert got == sorted(want)
    assert sorted(map(str, dc.contamination(one, two).collect())) == sorted(map(str, dc._scan(one, ["doc_id"], [(None if n is None else str(n), t) for n, t in items], 13, dc.RESULTS).collect()))


def test_false_alarms_of_a_full_bitmap_change_nothing(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([2, 14, 30])))) for i in range(60)]
    docs = [(i, " ".join([*rng.choices(words, k=30), *(items[i % 60][1].split() if i % 3 == 0 else []), *rng.choices(words, k=9)])) for i in range(80)]
    one, two = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, dc.contamination(one, two).collect()))
    monkeypatch.setattr(dc, "ITEMS_BYTES", 300)
    monkeypatch.setattr(windows, "LEAST_BITS", 6)
    monkeypatch.setattr(windows, "MOST_BITS", 6)
    assert sorted(map(str, dc.contamination(one, two).collect())) == want


def test_long_texts_are_hashed_by_stretches(monkeypatch):
    class Every:
        def may_hold(self, h):
            return np.isin(h, wanted)

    passage = " ".join(f"q{i}" for i in range(30)).encode()
    text = b" ".join([b"x"] * 500 + [passage] + [b"y" * 300] * 3 + [passage])
    wanted = windows.hashes(passage, *windows.bounds(passage), 13)
    monkeypatch.setattr(windows, "STRETCH", 64)
    n, runs = windows.candidate_runs(text, [13], 13, Every())
    assert n == 563 and [(a, w) for a, w, _ in runs] == [(500, passage), (533, passage)]
    assert all(sorted(m) == sorted(wanted.tolist()) for _, _, m in runs)
