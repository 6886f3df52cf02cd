"""Operator 12: fill-in-the-middle transformation over runs of character classes.

A text is held as its maximal runs of one class (white space or ink): where each run ends, and how many units stand up
to there. A cut after so many units is found by a binary search for the run that holds it and by arithmetic within
the run; the text is not read again, and no unit is ever made a string of its own. Units are

* ``token``: a stretch of ink with the white space before it, or the white space at the text's end: each run of ink
  ends a unit, and so does the last run;
* ``char``: a code point: a run has as many units as code points.

Cuts, form and order of the parts come from the SHA-256 of ``<seed>:<doc_id>``, so reruns and lost tasks agree: the
prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) of n units, the middle after the larger. A text stays
as it is (``plain``) if it is empty, holds one of the marks, or h3 % 100 is ``percent`` or more; else it becomes
``spm`` if h4 % 100 < ``spm_percent``, and ``psm`` otherwise. ``restored`` makes the text again from output and form.

Rows: each row is worked off by itself; equal doc_ids get equal draws, and rows without one those of an empty number.
A null text is empty: 0 units, plain, an empty output. An empty table gives an empty result. Columns of the input stay
beside the results unless they bear a result's name in any case, in which case the result takes their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import claim, kept_beside, named_apart, quoted, table

#: Marks before prefix, suffix and middle. The first character of each stands nowhere else in any of them, so that
#: the end of a part can never be read as the beginning of a mark.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
PERCENT = 50
SPM_PERCENT = 80
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class ClassRuns:
    """The runs of a text: ``ends`` in code points, ``units`` up to each end."""

    def __init__(self, raw: bytes, unit: str = "token"):
        points = np.frombuffer(raw, np.uint8)
        if not raw.isascii():
            points = points[(points & 0xC0) != 0x80]  # a byte for each code point
        blank = _BLANK[points]
        self.ends = np.append(np.flatnonzero(blank[1:] != blank[:-1]) + 1, len(points)) if len(points) else np.zeros(0, np.int64)
        if unit == "char":
            self.units = self.ends
        else:
            closing = ~blank[self.ends - 1]
            closing[-1:] = True
            self.units = np.cumsum(closing)

    def __len__(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, unit: int) -> int:
        """Code points up to the end of so many units."""
        if unit <= 0 or not len(self.ends):
            return 0
        run = int(np.searchsorted(self.units, unit))
        return int(self.ends[run] - (self.units[run] - unit))


def _cuts(unit: str):
    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        n, low, high = (np.zeros(len(texts), np.int64) for _ in range(3))
        for i, (text, a, b) in enumerate(zip(texts, first.to_numpy(), second.to_numpy(), strict=True)):
            runs = ClassRuns(text.as_py().encode("utf-8", "surrogatepass"), unit)
            n[i] = len(runs)
            ends = sorted((int(a) % (len(runs) + 1), int(b) % (len(runs) + 1)))
            low[i], high[i] = runs.cut(ends[0]), runs.cut(ends[1])
        return pa.StructArray.from_arrays([pa.array(x) for x in (n, low, high)], names=["n", "low", "high"])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        claim("fill_middle")
        for batch in batches:
            yield cut(*batch)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n long, low long, high long")


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _checked(marks: tuple[str, str, str]) -> None:
    if not all(marks) or any(a.startswith(b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
        raise ValueError("no mark may be empty or begin another")
    if any(m[0] in x[1:] for m in marks for x in marks):
        raise ValueError("the first character of a mark may stand nowhere else in a mark")


def fill_in_middle(docs: DataFrame, unit: str = "token", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    _checked(marks)
    if unit not in ("token", "char"):
        raise ValueError(f"no such unit: {unit}")
    keep = kept_beside(docs.columns, RESULTS)
    fresh = {x: named_apart(docs.columns, f"__{x}") for x in ("text", "draws", "cut")}
    text, cut = quoted(fresh["text"]), fresh["cut"]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = F.struct(*(_draw(digest, i).alias(f"h{i + 1}") for i in range(4)))
    drawn = docs.select(*map(quoted, keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(fresh["text"]), draws.alias(fresh["draws"]))
    h = lambda i: F.col(f"{fresh['draws']}.h{i}")
    drawn = drawn.withColumn(cut, _cuts(unit)(text, h(1), h(2)))
    low, high = F.col(f"{cut}.low"), F.col(f"{cut}.high")
    marked = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    form = F.when((text == "") | marked | (h(3) % 100 >= percent), "plain").when(h(4) % 100 < spm_percent, "spm").otherwise("psm")
    size = F.length(text)
    one = F.lit(1).cast("long")
    part = lambda a, b: F.substr(text, (a + one).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0).cast("long"), low), part(low, high), part(high, size.cast("long"))
    p, s, m = map(F.lit, marks)
    output = F.when(form == "plain", text).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut_off = form != "plain"
    return drawn.select(
        *map(quoted, keep),
        F.col(f"{cut}.n").alias("n"),
        form.alias("form"),
        F.when(cut_off, low).alias("prefix_chars"),
        F.when(cut_off, high - low).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``fill_in_middle`` made the output."""
    p, s, m = marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    lead = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s))
    behind = F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    head = F.substr(head, F.length(lead) + 1)
    place = F.call_function("instr", head, behind)
    ahead, rest = F.substr(head, F.lit(1), place - 1), F.substr(head, place + F.length(behind))
    prefix, suffix = F.when(form == "psm", ahead).otherwise(rest), F.when(form == "psm", rest).otherwise(ahead)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs)
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
