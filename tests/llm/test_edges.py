"""Nulls, empty tables, long texts, ties, repeated rows and clashing column names, operator by operator."""

import random

import numpy as np
import pytest

from factgraph.llm import embedding_groups, jaccard_join, language, mixing, quality_rules, token_blocks, warc_store
from factgraph.llm.common import Workspace, kept_beside, named_apart

# ---- shared -------------------------------------------------------------------------------------------------------


def test_names():
    assert named_apart(["A", "_a"], "a") == "__a" and named_apart([], "a") == "a"
    assert kept_beside(["x", "SCORE", "y"], ["score"]) == ["x", "y"]


# ---- 2 ------------------------------------------------------------------------------------------------------------


def test_jaccard_with_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 5, "a"), (2, long + " end", 5, "b"), (3, "short text here now", 5, "c"), (4, None, 5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, Workspace(spark, "t"), 3, 90, 100).collect()}
    assert got == {1: (59_998, 1), 2: (59_999, 1), 3: (2, 3), 4: (0, 4)}
    kept = jaccard_join.one_of_each_group(df, Workspace(spark, "t"), 3, 90, 100)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_jaccard_at_the_threshold(spark):
    words = [f"w{i}" for i in range(21)]  # 19 shingles; 18 of 20 shared is exactly 90 %
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"]))], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_groups(df, Workspace(spark, "t"), 3, 90, 100).collect()} == {1}
    assert {r.component_id for r in jaccard_join.jaccard_groups(df, Workspace(spark, "t"), 3, 91, 100).collect()} == {1, 2}


# ---- 4 ------------------------------------------------------------------------------------------------------------


def test_mix_with_clashing_names_and_torn_repeats(spark):
    rows = [(7, "a b c", "s", i, "x") for i in range(40)] + [(8, "d e", None, 0, "y"), (9, None, "s", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, `__s` string")
    plan = [r for r in mixing.mix_plan(df, Workspace(spark, "t")).collect()]
    out = mixing.mixed_documents(df, Workspace(spark, "t"))
    assert out.columns == df.columns
    got = out.collect()
    assert sum(3 if r.doc_id == 7 else 2 for r in got) == sum(r.taken for r in plan) and all(r.text for r in got)
    assert len({r.taken for r in plan if r.doc_id == 7}) == 2  # the border runs between rows of one doc_id
    assert {r.times for r in got if r.doc_id == 7} == set(range(40))


def test_mix_of_texts_without_blanks_is_sorted_in_small_parts(spark):
    rows = [(i, "字" * (200 + i % 50), "zh") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    work = Workspace(spark, "t")
    plan = mixing.mix_plan(df, work, share=0.5).collect()
    assert abs(sum(r.taken for r in plan) - 1500) <= 1
    sized = spark.read.parquet(f"{work.path}/sized")
    assert sized.groupBy("bin").count().agg({"count": "max"}).first()[0] < 200


def test_mix_by_a_column_of_weights(spark):
    rows = [(i, "a b", "s", 1000.0 if i % 2 else 0.001) for i in range(400)] + [(500, "a b", "s", None), (501, "a b", "s", -1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, worth double")
    taken = {r.doc_id: r.taken for r in mixing.mix_plan(df, Workspace(spark, "t"), share=0.5, weight="worth").collect()}
    assert sum(taken[i] > 0 for i in range(1, 400, 2)) > 195 and taken[500] == taken[501] == 0


def test_long_document_in_the_mix(spark):
    df = spark.createDataFrame([(1, "a " * 200_000, "s"), (2, "b", "t")], "doc_id long, text string, source string")
    assert {r.doc_id: (r["size"], r.taken) for r in mixing.mix_plan(df, Workspace(spark, "t")).collect()}[1][0] == 200_000


# ---- 6 ------------------------------------------------------------------------------------------------------------


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "q"), (1, "a b", 2, "q"), (2, None, 3, "q"), (3, "z " * 100_000, 4, "q")], "doc_id long, text string, stat_n_bytes int, quality_score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.scored(docs, quality_rules.fit(docs, labels), docs.columns)
    assert out.columns == ["doc_id", "text", "stat_n_bytes", "quality_score"]
    got = out.collect()
    assert len(got) == 4 and {r.quality_score for r in got} == {0.5} and sorted(r.stat_n_bytes for r in got) == [1, 2, 3, 4]
    assert quality_rules.scored(docs.limit(0), quality_rules.fit(docs.limit(0), labels), ["doc_id"]).count() == 0
    assert quality_rules.statistics(docs, ["doc_id"]).where("doc_id = 3").first().stat_n_words == 100_000


# ---- 7 ------------------------------------------------------------------------------------------------------------


def test_letters():
    assert [language.has_letter(t) for t in (None, "", "½ ² 12", "①", "Ⅷ", "!?", "٣", "é", "中", "12a")] == [False] * 7 + [True] * 3


def test_language_edges(spark):
    rng = random.Random(2)
    make = lambda kinds: " ".join("".join(rng.choices(kinds, k=2)) for _ in range(40))
    rows = [(i, make(["tha", "ing"]) if i % 2 else make(["sch", "ung"]), "en" if i % 2 else "de", i, "s") for i in range(200)]
    rows += [(300, rows[1][1], None, 1, "s"), (300, rows[1][1], None, 1, "s"), (301, "½ ² 12", "en", 1, "s"), (302, "thaing " * 40_000, None, 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int, `LANG_SCORE` string")
    kept = language.determined(df)
    assert kept.columns == df.columns and kept.where("doc_id = 301").count() == 0 and kept.where("doc_id = 300").count() == 2
    out = language.tagged(df, language.fit(df), df.columns)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in out.collect()}
    assert got[301] == ("und", 0.0) and got[300] == got[1] and got[302][0] == "en"
    assert language.determined(df.limit(0)).count() == 0


# ---- 8 ------------------------------------------------------------------------------------------------------------


def test_embedding_ties_repeats_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [8.999999, 3.0, 3.0, 1.0]), (5, [0.0, 0.0, 0.0, 1.0]), (5, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, cell string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups.embedding_groups(df, Workspace(spark, "t")).collect())
    assert got[:3] == [(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False)]  # 1 and 2 at a cosine of exactly 0.9
    assert len(got) == 5 and {g[2] for g in got[3:]} == {5}


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_urls_cannot_forge_header_fields(spark):
    urls = ["http://a\r\nWARC-Refers-To: <urn:page:7>", "http://b\nWARC-Payload-Digest: sha1:zz\n", "c\x85d WARC-Type: revisit", "", None, "http://ä?x=\t1"]
    df = spark.createDataFrame([(i, u, "text", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, sha256 int")
    path = f"{Workspace(spark, 't').path}/a"
    warc_store.write_archive(df, path)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_store.archive_index(spark, path).collect()}
    assert got == {i: ("response", None) for i in range(len(urls))}
    assert {r.page_id: r.url for r in spark.read.parquet(f"{path}/records").collect()} == dict(enumerate(urls))
    for r in warc_store.archive_records(spark, path).collect():
        head = bytes(r.record).partition(b"\r\n\r\n")[0]
        assert head.count(b"WARC-Type") <= 2 and b"\n" not in head.replace(b"\r\n", b"") and len(head.split(b"\r\n")) in (7, 8)


def test_equal_and_missing_page_ids(spark):
    big = "x" * 3000
    df = spark.createDataFrame([(4, "u", big), (4, "v", big), (None, "w", big), (3, "z", big), (None, "a", "small"), (5, "long", "y" * 2_000_000)], "page_id long, url string, html string")
    path = f"{Workspace(spark, 't').path}/a"
    warc_store.write_archive(df, path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc_store.archive_index(spark, path).collect()), key=repr)
    assert got == sorted([(4, "response", None, 3000), (4, "response", None, 3000), (None, "revisit", 4, 3000), (3, "revisit", 4, 3000), (None, "response", None, 5), (5, "response", None, 2_000_000)], key=repr)


# ---- 1 ------------------------------------------------------------------------------------------------------------


def test_slices_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_blocks, "BATCH_BYTES", 10)
    texts = ["aaaa", "bbbb", None, "", "cccc", "d" * 50, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = [p.column(1).to_pylist() for p in token_blocks._slices(batch)]
    assert parts == [["aaaa", "bbbb", None, ""], ["cccc"], ["d" * 50], ["e"]]
    assert list(token_blocks._slices(batch.slice(0, 0))) == []


def test_known_words_are_bounded_by_bytes(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_blocks, "CACHED_BYTES", 20_000)
    enc = token_blocks.WordEncoder(public.path("word_bpe_49k.json"))
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(50))
        assert enc.encode_batch([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc.words) + len(enc.words.older) < 250
