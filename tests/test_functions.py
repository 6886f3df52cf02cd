"""Literal expectations of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.functions import vectors as V
from factgraph.operators import chunking, filters


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (T.norm_exact, "  Alice   Smith ", "alice smith"),
        (T.norm_exact, None, None),
        (T.norm_fuzzy, "Alice-Smith!", "alice smith"),
        (T.strip_plural, "Boxes glass cats is", "box glass cat is"),
        (T.name_entropy, "", 0.0),
        (T.high_entropy, "meaningful name", True),
        (T.high_entropy, "aa", False),
        (lambda c: F.array_sort(T.shingles(c)), "alice", ["ali", "ice", "lic"]),
        (T.shingles, "ab", []),
        (T.shingles, "a", ["a"]),
        (T.shingles, "", []),
        (lambda c: F.size(T.minhash_signature(T.shingles(c))), "alice", 32),
        (lambda c: F.size(T.lsh_bands(T.minhash_signature(T.shingles(c)))), "alice", 8),
        (T.normalize_relation, "IS_Located-In_the", "located in"),
        (T.normalize_relation, "can be grown by", "grown by"),
        (T.sanitize_label, " grown / by! ", "GROWN_BY"),
        (T.sanitize_label, "!!", "RELATED_TO"),
        (lambda c: T.extract_label(c, ["A_B", "C"], "D"), '- "a_b", since', "A_B"),
        (lambda c: T.extract_label(c, ["A_B", "C"], "D"), "none", "D"),
        (lambda c: T.truncate_at_sentence(c, 40), "First sentence. Second sentence. Third sentence. Fourth sentence.", "First sentence. Second sentence."),
        (lambda c: T.truncate_at_sentence(c, 5), "abcdefgh", "abcde"),
        (lambda c: T.truncate_at_sentence(c, 5), None, None),
        (T.clean_input, "a​b\u0000c\n\td", "abc\n\td"),
        (lambda c: T.chunk_label(c, F.lit("u")), "book-part_12", "12"),
        (lambda c: T.chunk_label(c, F.lit("u")), "book-part_x", "u"),
        (lambda c: T.format_secs(c.cast("int")), "3725", "01:02:05"),
        (T.json_salvage, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        (T.json_salvage, 'so {"a": {"b": 1}} end', '{"a": {"b": 1}}'),
        (T.escape_tsv, "a\tb\\c\nd\r", "a\\tb\\\\c\\nd\\r"),
        (T.lucene_sanitize, "This has every escape character + - && || ! ( ) { } [ ] ^ \" ~ * ? : \\ /", None),
        (T.fulltext_query, "the red, widget (is) new", "red | widget | new"),
        (T.clean_name, "​ Anna ﻿", "Anna"),
        (T.word_count, "naïve word_1, two", 3),
    ],
)
def test_scalar(spark, make, value, want):
    got = one(spark, value, make)
    if want is None and value is not None:
        assert "\\+" in got and got.startswith("\\This") and "\\&\\&" in got
    else:
        assert got == want


def test_entropy_orders_names(spark):
    assert one(spark, "alice", T.name_entropy) > one(spark, "aaaaa", T.name_entropy) == 0.0


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], []), (["a", "b"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.l2_normalize(F.col("a")).alias("n")).collect()
    assert rows[0]["c"] == pytest.approx(0.96) and rows[0]["n"] == [0.6, 0.8]
    assert rows[1]["c"] == 0.0 and rows[1]["n"] == [0.0, 0.0]


def test_date_groups_keep_their_own_dates(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2021-01-01",), ("2022-01-01",), (None,)], "d string").select(F.to_timestamp("d").alias("d"))
    test = filters.date_dnf(F.col("d"), [[("<", "2020-06-01")], [(">", "2021-06-01")], [("IS NULL", None)]])
    assert df.where(test).count() == 3


def test_group_id():
    assert filters.check_group_id("a-b_1") == "a-b_1" and filters.check_group_id("") == ""
    with pytest.raises(ValueError):
        filters.check_group_id("a b")


def test_chunks():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(20))
    chunks = chunking.split_recursive(text, 400, 50)
    assert all(0 < len(c) <= 400 for c in chunks) and all(f"Paragraph {i}." in " ".join(chunks) for i in range(20))
    assert chunking.split_recursive("", 10, 2) == [] and "".join(chunking.split_recursive("x" * 25, 10, 0)) == "x" * 25
    packed = chunking.pack_paragraphs("é" * 30 + "\n\nab cd\n\nef", 20)
    assert all(len(p.encode()) <= 20 for p in packed) and "".join(packed).count("é") == 30 and "ab cd\n\nef" in packed
