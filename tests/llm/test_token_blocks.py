import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import token_blocks as tb

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
TEXTS = ["", None, "Plain words, here.", "Ünïcode Straße ÀÉ don't we'll 3.14 ¶ a¶b x\t\ty <|endoftext|> İstanbul ΣΑΣ", "\n\n \r", "中文 текст ﬁ Å \x1c b", "long " * 5000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.integers(0, 16))
def test_blocks_come_back(values, shift):
    a = np.array(values, np.uint32) >> np.uint32(shift)
    low, width, starts, marks, packed, at, high = tb.pack_blocks(a)
    got = tb.unpack_blocks(len(a), low, width, starts, marks, np.frombuffer(packed, np.uint8), at, high)
    assert got.tolist() == a.tolist()


def test_outliers_go_to_the_exception_list():
    a = np.full(128, 7, np.uint32)
    a[5] = 1_000_000
    *_, at, high = tb.pack_blocks(a)
    assert at.tolist() == [5] and high.tolist() == [999_993]


def test_segment_round_trip():
    payload = tb.write_segment([3, None], [2, 1], np.array([9, 70000, 1], np.uint32))
    ids, counts, values = tb.read_segment(payload)
    assert (ids, counts.tolist(), values.tolist()) == ([3, None], [2, 1], [9, 70000, 1])


def test_word_encoder_equals_the_library():
    t = tokenizers.Tokenizer.from_file(PATH)
    enc = tb.WordEncoder(PATH)
    for _ in range(2):
        got = enc.encode_batch([x or "" for x in TEXTS])
        assert [g.tolist() for g in got] == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def brute(rows, end=1):
    t = tokenizers.Tokenizer.from_file(PATH)
    start, out = 0, []
    for doc_id, ids in sorted(((d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return (r[1], r[2])


def test_corpus(spark):
    rows = [(i * 7 % 11, x) for i, x in enumerate(TEXTS)] + [(50, "same"), (50, "same"), (None, "null id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = [tuple(r)[:4] for r in tb.token_corpus(df, PATH).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert tb.token_corpus(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB.,'sıİßéÉ§$%|<>~\"-_0 9\n\t\x0b ́ΑΣς中ﬁ¶reL()[]\\/`^&*+=#@!?;:", max_size=40), max_size=4))
def test_word_encoder_on_any_text(texts):
    enc = tb.encoder(PATH)
    assert [g.tolist() for g in enc.encode_batch(texts or [""])] == [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts or [""]]
