import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import backoff, embedding_groups, language, main_text, quality_rules, warc_store
from factgraph.llm.common import Workspace
from factgraph.llm.decontaminate import words

# ---- 3 ----------------------------------------------------------------------------------------------------------

PAGE = """<html><body><header class="site-header"><h1>Site</h1></header><div id="cookie-banner">We use cookies, yes.</div>
<div class="main no-sidebar"><div class="sidebar"><p>Side text, long enough to be counted as a paragraph, really.</p></div>
<div class="content"><h1>Title</h1><p>First paragraph, with commas, and more   text so that it is long enough.
<p>Second one, has a <a href=x>link</a> inside it, and text &amp; <b>marks</b>.<ul><li>item one<li>item two</ul>
<form><p>Subscribe here, now, please do it.</p></form><script>var a = "</p>";</script><!-- no --></div></div>
<div id="comments"><p>Reader comment, is long, very long, and has commas, too.</p></div><footer>foot</footer></body></html>"""


def test_main_text():
    want = ["Title", "First paragraph, with commas, and more text so that it is long enough.", "Second one, has a link inside it, and text & marks.", "item one", "item two"]
    assert main_text.main_text(PAGE).split("\n") == want
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>menu</nav>") == ""
    assert main_text.main_text("<article><h1>A</h1><p>Cut &am") == "A\nCut &am"
    assert main_text.main_text("<p>a<p>b <i>c") == "a\nb c"
    assert main_text.main_text('<article><p>One, two.<p class="ad">Buy!<p>Three, four.</article>') == "One, two.\nThree, four."
    assert main_text.main_text('<article><div><p class="ad">Buy!</div><p>Three, four.</article>') == "Three, four."
    assert len(main_text.main_text("<article>" + "<p>word, word</p>" * 20000 + "</article>")) == 20000 * 11 - 1


def test_main_text_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("main_text", F.lit(1))
    out = main_text.extracted(df, ["page_id", "url", "main_text"])
    got = {r.page_id: r.main_text for r in out.collect()}
    assert out.columns == ["page_id", "url", "main_text"] and out.count() == 3
    assert got[2] == "" and got[1].startswith("Title\n")
    assert main_text.extracted(df.limit(0), ["page_id"]).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------------------------


def brute_backoff(rows):
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(words(t))
    c1, c2, total = Counter(), Counter(), 0
    own1, own2 = {d: Counter() for d in texts}, {d: Counter() for d in texts}
    for d, many in texts.items():
        for w in many:
            own1[d].update(w)
            own2[d].update(zip(w, w[1:], strict=False))
    for d in texts:
        c1 += own1[d]
        c2 += own2[d]
    total = sum(c1.values())
    out = {}
    for d, many in texts.items():
        rest = max(total - sum(own1[d].values()), 0.5)
        s = 0.0
        for w in many:
            for i, x in enumerate(w):
                back = math.log(max(c1[x] - own1[d][x], 0.5) / rest)
                if i and c2[w[i - 1], x] > own2[d][w[i - 1], x]:
                    s += math.log((c2[w[i - 1], x] - own2[d][w[i - 1], x]) / (c1[w[i - 1]] - own1[d][w[i - 1]]))
                else:
                    s += back + (math.log(backoff.ALPHA) if i else 0)
        out[d] = s
    return out


def test_backoff(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "a", *(f"w{k}" for k in range(40))], [30, 10, *[1] * 40], k=rng.randrange(0, 60)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "alone"), (83, "the " * 700 + "end")]
    got = {r.doc_id: r.score for r in backoff.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()}
    assert got == pytest.approx(brute_backoff(rows))
    assert backoff.backoff_scores(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark, "t")).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------------------------


def test_quality_rules(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(60)) + "."
    bad = lambda: " ".join(["SPAM!!"] * 60) if rng.random() < 0.5 else " ".join([w + "###" for w in good().split()])
    rows = [(i, good() if i % 3 else bad()) for i in range(900)]
    docs = spark.createDataFrame([*rows, (901, None), (902, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1 if i % 3 else 0) for i, _ in rows), (901, None), (5000, 1)], "doc_id long, quality int")
    model = quality_rules.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality_rules.scored(docs, model, ["doc_id"]).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(i % 3) for i in held]) > 0.95 and len(held) > 100
    assert all(0 <= s <= 1 for s in got.values()) and got[901] == got[902]
    values = np.array([quality_rules.describe(t) for _, t in rows[:50]])
    assert model.score(values) == pytest.approx([got[i] for i in range(50)])
    assert quality_rules.train(np.zeros((0, 22)), np.zeros(0)).score(np.zeros((1, 22))) == pytest.approx([0.5])


# ---- 7 ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(2)
    kinds = {"xx": ["tha", "ing", "wha", "and"], "yy": ["ión", "que", "ñas", "los"], "zz": ["sch", "ung", "ein", "über"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(rng.randrange(3, 90))), k) for i in range(600) for k in [list(kinds)[i % 3]]]
    df = spark.createDataFrame([*rows, (700, None, "xx"), (701, "12 34 !!", "xx"), (702, "", None), (None, "thaing", "xx")], "doc_id long, text string, lang string")
    net = language.fit(df)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.tagged(df, net, ["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i][0] == k for i, _, k in held]) > 0.95 and len(held) > 100
    assert got[700] == got[701] == got[702] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert {r.doc_id for r in language.determined(df).collect()}.isdisjoint({700, 701, 702})
    assert language.train([], []).predict(["abc"]) == [("und", 0.0)]


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    v = np.concatenate([centres[i % 60] + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.4]) for i in range(600)]).reshape(600, 24)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(700 + i, [float(x) for x in v[0]]) for i in range(5)]
    extra = [(800, None), (801, [0.0] * 24), (802, [float("nan")] * 24), (803, [1.0, 2.0]), (804, [2.0, 4.0]), (805, []), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_groups.embedding_groups(df, Workspace(spark, "t")).collect() if r.vec_id is not None}
    u = np.array([r for _, r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    ids = [i for i, _ in rows]
    want, have = link.sum(axis=1), np.array([got[i].n_links for i in ids])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum() and want.sum() > 2000
    assert got[700].component_id == got[0].component_id and not got[700].kept
    assert [got[i].n_links for i in (800, 801, 802, 805)] == [0] * 4 and got[804].component_id == 803
    assert embedding_groups.embedding_groups(df.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize(("block", "part"), [(4096, 16384), (100, 350)])
def test_embeddings_finds_every_link_among_many_cells(spark, monkeypatch, block, part):
    """Hundreds of cells, and pairs just above and below the threshold in all directions."""
    monkeypatch.setattr(embedding_groups, "PER_CELL", 4)
    monkeypatch.setattr(embedding_groups, "SAMPLE_PER_CELL", 1)
    monkeypatch.setattr(embedding_groups, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_groups, "PART_ROWS", part)
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    one = unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=one.shape)
    side = unit(side - (side * one).sum(axis=1)[:, None] * one)
    cos = np.where(np.arange(1500) % 5, 0.9 + 1e-9, 0.9 - 1e-9)[:, None]
    v = np.concatenate([one, cos * one + np.sqrt(1 - cos * cos) * side])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_groups.embedding_groups(df, Workspace(spark, "t")).collect()}
    u = unit(v)
    want = ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist()
    assert sum(got.values()) == sum(want) == 2400 and [got[i] for i in range(len(v))] == want


def test_cells_out_of_reach_are_left_out():
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    v = centres[[0] * 50] + rng.normal(size=(50, 8)) * 0.01
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert embedding_groups.reachable(v, np.zeros(50, np.int64), centres, 0.9).tolist() == [[True] + [False] * 7] * 50


def test_cells_share_blocks_or_have_their_own():
    counts = {(8, 0): 3, (8, 1): 4, (8, 2): 25, (8, 3): 6, (16, 0): 2, (16, 1): 10}
    assert embedding_groups.blocks_of_cells(counts, 10) == {(8, 0): (0, 1), (8, 1): (0, 1), (8, 2): (1, 3), (8, 3): (4, 1), (16, 0): (5, 1), (16, 1): (6, 1)}


# ---- 9 ----------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big, umlaut = "<p>" + "x" * 1200, "ä" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e", None), (7, "http://f", umlaut), (8, "http://g", umlaut)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = f"{Workspace(spark, 't').path}/a"
    warc_store.write_archive(df, path)
    got = {r.page_id: tuple(r)[1:] for r in warc_store.archive_index(spark, path).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert got[page][:2] == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: v[2:] for k, v in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 8), 8: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc_store.archive_records(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[length:] == b"\r\n\r\n" and bytes(r.payload) == (dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()
    empty = f"{Workspace(spark, 't').path}/b"
    warc_store.write_archive(df.limit(0), empty)
    assert warc_store.archive_index(spark, empty).count() == 0
