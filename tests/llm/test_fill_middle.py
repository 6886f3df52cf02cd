"""Cuts, forms and round trips against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgraph.llm import fill_middle
from factgraph.llm.fill_middle import ClassRuns, fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, unit="token", percent=50, spm_percent=80, marks=("<P>", "<S>", "<M>"), seed=42):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é中😀\t\n\v\f\r\x1c\x85   <>PSM"), max_size=40))
def test_runs_cut_where_units_end(text):
    for unit, units in (("token", TOKEN.findall(text)), ("char", list(text))):
        runs = ClassRuns(text.encode(), unit)
        assert len(runs) == len(units)
        assert [runs.cut(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]


ROWS = [
    *((i, f"word{i} two\tthree é中😀 four\n" * (i % 7) + " " * (i % 3)) for i in range(120)),
    (200, None), (201, ""), (202, " \n"), (203, "has <P> in it"), (204, "<S>"), (205, "x<M>"), (206, "a <P b <S c <M d > e <"), (207, "<<P<<S<<M<< <"),
    (None, "no id at all"), (None, None), (7, "the same id again"), (7, "the same id again"), (208, "long " * 300_000), (209, "x" * 500_000),
]


@pytest.mark.parametrize("options", [{}, {"unit": "char"}, {"percent": 100, "spm_percent": 0}, {"percent": 100, "spm_percent": 100, "seed": 7}, {"percent": 0}, {"percent": 100, "marks": ("[pre]", "{suf}", "(mid)")}])
def test_against_plain_python(spark, options):
    df = spark.createDataFrame([(*r, i, "out") for i, r in enumerate(ROWS)], "doc_id int, text string, N int, `output.x` string")
    out = fill_in_middle(df, **options)
    assert out.columns == ["doc_id", "text", "output.x", "n", "form", "prefix_chars", "middle_chars", "output"]
    again = restored(F.col("output"), F.col("form"), options.get("marks", fill_middle.MARKS))
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
    assert got == sorted(((d, t, *brute(d, t, **options)) for d, t in ROWS), key=repr)
    assert out.where(~again.eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    if options.get("percent") == 100 and "marks" not in options:
        assert {r.form for r in out.where("doc_id = 206").collect()} <= {"spm", "psm"}


def test_empty_table_and_bad_marks(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError, match="mark"):
            fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), marks=marks)
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="line")
