"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from factgraph.llm import spelling
from factgraph.llm.common import Workspace


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, chars, least, ratio, slips):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slips and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= chars and c >= least}
    near = {w: [o for o in n if one_apart(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def computed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, word string, `N` int").repartition(3)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r[c] for c in columns) for r in spelling.spelling_variants(df, Workspace(spark, "t"), **options).collect())


def noisy(rng, letters, words, docs):
    stems = ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(words)]

    def altered(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        return [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]][kind]

    text = lambda: " ".join(altered(w) if rng.random() < 0.2 else w.upper() if rng.random() < 0.1 else w for w in rng.choices(stems, [40 / (k + 1) for k in range(words)], k=60))
    return [(i if i % 7 else None, text()) for i in range(docs)]


@pytest.mark.parametrize(("letters", "options"), [("ab", {"chars": 2, "least": 1, "ratio": 2}), ("abcdeé÷", {"chars": 3, "least": 2, "ratio": 3}), ("abcdefghijÀÿ", {"chars": 3, "least": 1, "ratio": 1.5}), ("abc", {"chars": 1, "least": 1, "ratio": 2, "slips": False})])
def test_against_brute_force(spark, letters, options):
    rng = random.Random(len(letters))
    rows = [*noisy(rng, letters, 40, 60), (1, None), (2, ""), (3, "!? 12 _"), (3, "中文 Ā × ÉCOLE école"), (3, "中文 Ā × ÉCOLE école")]
    assert computed(spark, rows, **options) == brute(rows, options["chars"], options["least"], options["ratio"], options.get("slips", True))


def test_production_parameters_and_chains(spark):
    rows = [(i, "necessary " * 300 + "necesary " * 25 + "nicesary nicesary") for i in (1, 2)] + [(3, "tiewords tiewordz tiewordy " * 20 + "tieword tieword")]
    got = {r[0]: r[1:] for r in computed(spark, rows)}
    want = {r[0]: r[1:] for r in brute(rows, 7, 2, 10, True)}
    assert got == want and got["tieword"][0] == "tiewords"
    assert got["nicesary"][1] == "necessary"


def test_a_tie_is_no_circle_and_small_tables_pass(spark):
    assert computed(spark, []) == [] and computed(spark, [(1, "short words only")]) == []
    assert [r[1] for r in computed(spark, [(1, "aaaaaaa aaaaaab " * 3)])] == [None, None]


def test_very_long_words(spark, monkeypatch):
    long = "ab" * 150_000
    rows = [(1, f"{long} " * 20), (2, f"{long}b {long}b {long[:-2]}ba {long[:-2]}ba {long[1:]} {long[1:]}")]
    got = {r[0]: r[1:] for r in computed(spark, rows, slips=False)}
    assert {w: g[3] for w, g in got.items()} == {long: 2, long + "b": 1, long[:-2] + "ba": 0 + one_apart(long[:-2] + "ba", long[1:]) + one_apart(long[:-2] + "ba", long + "b"), long[1:]: 1}
    assert got[long + "b"][0] == long == got[long[1:]][0]


def test_counted_tables_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "COUNTED", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(f"{a}{b}ccccccc" for a in "abc" for b in "abc")] * 2)], names=["doc_id", "text"])
    parts = [r for b in spelling._counted(7, False)([batch]) for r in b.to_pylist()]
    total = Counter()
    for r in parts:
        total[r["word"]] += r["n"]
    assert len(parts) > len(total) == 9 and set(total.values()) == {2}
