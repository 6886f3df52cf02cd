"""Operator 13: spelling variants, grouped by a symmetric-delete join.

Words are maximal runs of letters; ``form`` of a word is its near word (one code point inserted, deleted or replaced)
of largest count, if that is ``ratio`` times the word's or more; ``root`` is where the forms of forms end.

1. ``word_counts``: tasks count the words of documents in small letters, a bounded table at a time, and Spark sums them.
   Words of ``chars`` code points or more that occur ``least`` times stay, each with a number.
2. ``deletion_keys``: every word emits itself and each different string that one deletion makes of it, as a hash made
   from sums over the word's head and tail: a word of a million letters makes a million keys of a few bytes, and not
   a million strings. Deleting any letter of a run of equal ones makes the same string, so a key carries that run.
3. ``near_words``: words that share a key are joined on it. Two deletions of equal result leave words one replacement
   apart exactly where their runs overlap (else it is a transposition or the like), which is held against the runs in
   the join; whatever comes through is verified on the words themselves, which must be equal but for the letter at
   that place, in time in proportion to their length. A pair at distance one
   shares one key, so no pair comes twice. A key's words differ by the letter put in and its place, so no key has
   more of them than letters times places, whatever the corpus.
4. The near words are aggregated by word, and forms joined to roots level by level: words whose form has none itself,
   words whose form is one of those, and so on. Each level multiplies counts by ``ratio``, so there are few.

Steps 1 to 4 are written below the shared folder.

Rows: every row of documents counts, repeated ones too; a null doc_id is an empty number in the draw of deletions; null
and empty texts have no words. Ties between forms fall to the smallest in code-point order. Texts and words of any
length are taken whole. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, claim, give_back, table

#: Runs of letters in a text whose A-Z are small already.
LETTERS = re.compile("[a-zÀ-ÿ]+")
CHARS = 7
LEAST = 2
RATIO = 10
#: One in so many of a document's words loses a letter, by a checksum.
SLIP = 31
#: Different words that a task counts before it gives them on, and their bytes.
COUNTED, COUNTED_BYTES = 100_000, 8 << 20
#: Letters whose keys are made at once.
LETTERS_AT_ONCE = 1 << 18
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def small(text: str | None) -> str:
    """The text with A-Z in small letters, and no other change."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def slipped(word: str, doc_id: int | None) -> str:
    """The word as it counts in a document: one in SLIP loses a letter."""
    h = zlib.crc32(word.encode(), zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id)))
    return word if h % SLIP else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counted(chars: int, slips: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("spelling")
        counts: dict[str, int] = {}
        held = 0

        def given() -> Iterator[pa.RecordBatch]:
            words, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            for a in range(0, len(words), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 4096], pa.string()), pa.array(times[a : a + 4096])], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for match in LETTERS.finditer(small(text.as_py())):
                    if match.end() - match.start() >= chars:
                        own[match[0]] = own.get(match[0], 0) + 1
                for word, n in own.items():
                    word = slipped(word, doc_id) if slips else word
                    if len(word) >= chars:
                        before = counts.get(word)
                        held += 64 + 2 * len(word) if before is None else 0
                        counts[word] = n + (before or 0)
                        if len(counts) >= COUNTED or held >= COUNTED_BYTES:
                            yield from given()
                            held = 0
        yield from given()
        give_back()

    return run


def word_counts(docs: DataFrame, chars: int = CHARS, least: int = LEAST, slips: bool = True) -> DataFrame:
    """word, n of the words of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(chars, slips), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keys(ids: list[int], words: list[str]) -> pa.RecordBatch:
    """key, id, start, end of the words: themselves (start -1) and each run of equal letters less one of it."""
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word_of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(letters)) - starts[word_of]
    powers = np.cumprod(np.r_[_U(1), np.full(max(int(sizes.max()) - 1, 0), _B, np.uint64)])
    worth = _mixed(letters + _U(1)) * powers[at]
    sums = np.cumsum(worth)  # modulo 2^64, as all that follows
    before_word = np.where(starts > 0, sums[starts - 1], _U(0))
    whole = sums[ends - 1] - before_word
    head = sums - worth - before_word[word_of]
    tail = (whole[word_of] - head - worth) * _U(_B_INVERSE)
    closes = np.r_[(letters[1:] != letters[:-1]) | (word_of[1:] != word_of[:-1]), True]
    run_end = np.flatnonzero(closes)
    run_start = np.r_[0, run_end[:-1] + 1]
    of = word_of[run_end]
    length = lambda n: _mixed(n.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    keys = np.r_[_mixed(whole + length(sizes)), _mixed((head + tail)[run_end] + length(sizes[of] - 1))]
    numbers = np.array(ids, np.int64)
    none = np.full(len(words), -1)
    columns = [keys.view(np.int64), np.r_[numbers, numbers[of]], np.r_[none, at[run_start]].astype(np.int32), np.r_[none, at[run_end]].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "start", "end"])


def _deletions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("spelling")
    for batch in batches:
        ids, words, size = [], [], 0
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and size + len(word) > LETTERS_AT_ONCE:
                yield from _bounded(_keys(ids, words))
                ids, words, size = [], [], 0
            ids.append(number)
            words.append(word)
            size += len(word)
        if words:
            yield from _bounded(_keys(ids, words))
    give_back()


def _bounded(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, most):
        yield batch.slice(a, most)


def deletion_keys(words: DataFrame) -> DataFrame:
    """key, id, start, end for words(id, word): start and end of the run that lost a letter, -1 for the word itself."""
    return words.select("id", "word").mapInArrow(_deletions, "key long, id long, start int, end int")


def near_words(words: DataFrame, work: Workspace) -> DataFrame:
    """id, other, other_word, other_n: every ordered pair of words(id, word, n) at a distance of exactly one."""
    keys = work.keep(deletion_keys(words), "deletion-keys")
    a, b = keys.alias("a"), keys.alias("b")
    replaced = (F.col("a.start") >= 0) & (F.col("b.start") >= 0) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end"))
    one_more = (F.col("a.start") < 0) != (F.col("b.start") < 0)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (replaced | one_more))
    met = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.col("a.start") >= 0).alias("a_less"), (F.col("b.start") >= 0).alias("b_less"), F.greatest("a.start", "b.start").alias("at"))
    left = words.select(F.col("id").alias("a"), F.col("word").alias("a_word"), F.col("n").alias("a_n"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    less = lambda w, cut: F.when(F.col(cut), F.concat(F.substr(w, F.lit(1), F.col("at")), F.substr(w, F.col("at") + 2))).otherwise(F.col(w))
    met = met.join(left, "a").join(right, "b").where(less("a_word", "a_less") == less("b_word", "b_less"))
    met = met.drop("a_less", "b_less", "at")
    met = work.keep(met, "near")
    work.drop("deletion-keys")
    there = met.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("b_word").alias("other_word"), F.col("b_n").alias("other_n"))
    return there.union(met.select("b", "a", "a_word", "a_n"))


def roots(forms: DataFrame, work: Workspace, most: int = 64) -> DataFrame:
    """id, root for forms(id, form_id, form), the links of words that have one; counts rise along them, so they end."""
    links = forms.select("id", "form_id", "form")
    heads = links.select(F.col("id").alias("form_id"))
    level = work.keep(links.join(heads, "form_id", "left_anti").select("id", F.col("form").alias("root")), "roots-0")
    found, n = level, 0
    while level.take(1):
        n += 1
        if n > most:
            raise RuntimeError("forms run in a circle")
        level = work.keep(links.join(level.withColumnRenamed("id", "form_id"), "form_id").select("id", "root"), f"roots-{n}")
        found = found.union(level)
    return found


def spelling_variants(docs: DataFrame, work: Workspace, chars: int = CHARS, least: int = LEAST, ratio: int = RATIO, slips: bool = True) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs(doc_id, text)."""
    counts = word_counts(docs, chars, least, slips).withColumn("id", F.monotonically_increasing_id())
    words = work.keep(counts.select("id", "word", "n"), "words")
    near = near_words(words, work)
    best = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other_word").alias("word"), F.col("other").alias("id"))).alias("best"))
    known = words.join(best, "id", "left")
    takes = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    pick = lambda c: F.when(takes, c)
    known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), pick(F.col("best.word")).alias("form"), pick(-F.col("best.n")).alias("form_n"), pick(F.col("best.id")).alias("form_id"))
    known = work.keep(known, "forms")
    ends = roots(known.where(F.col("form_id").isNotNull()), work)
    return known.join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), Workspace(spark, "spelling"))


ORACLE_SQL = r"""
WITH RECURSIVE polynomial AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM polynomial WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY ALL),
b AS (SELECT *, list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))) AS bytes FROM g),
h AS (SELECT w, n, xor(list_reduce(bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM b, crc),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
holed AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS k FROM x),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM x),
near AS (SELECT a.word, b.word AS o, b.n AS m FROM holed a JOIN holed b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM less l JOIN v ON v.word = l.k UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN v ON v.word = l.k),
ranked AS (SELECT word, o, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, o) AS k FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN o END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN ranked ON ranked.word = v.word AND k = 1),
way AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, way.root FROM f JOIN way ON f.form = way.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN way ON way.word = f.word
"""
