"""Operator 11: lines that many documents share, as keep bitmaps.

A line's key is the line without white space at its ends and with A-Z in small letters. Keys of ``chars`` code points
or more that stand in ``docs_at_least`` documents or more lose their lines, all of them or (``spare_first``) all but
the first by doc_id, row and position.

1. ``numbered``: the documents with a number for each row and their count of lines, written, so that the numbers last.
2. ``line_keys``: one row for each different key of a document, with the places where it stands there: a key of 128
   hashed bits, so that different lines of a corpus of any size do not meet.
3. Those rows are range-partitioned and sorted by key, doc_id and row, so a line of a third of all documents spreads
   over many neighbouring tasks. A task streams its rows and holds fewer than ``docs_at_least`` of them: a key's rows
   go out as dropped once so many have been seen. A key that touches a border of the task goes on in the next one:
   the task then gives its count, and the few rows that the count does not decide, which are settled by a join of at
   most two keys a task.
4. The dropped places go back to their documents and become a bitmap: nothing if every line stays, else a byte that
   says whether bits or their zlib form follow, whichever is shorter. No text crosses a shuffle for this.

``kept_text`` applies the bitmaps to the texts.

Rows: every row is a document of its own, repeated and null doc_ids too; null and empty texts are one empty line.
Documents that repeat a key count once for it. Lines of white space alone have an empty key, below ``chars``, and stay.
Null doc_ids come last in the order of first occurrences. An empty table gives an empty result. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, claim, give_back, table

DOCS_AT_LEAST = 10
CHARS = 1
BLANKS = b" \t\n\v\f\r"
#: Rows that a task gathers by document before it gives them on.
GATHERED = 1 << 16
DROPPED, OPEN, COUNT = 0, 1, 2
_STREAMED = "kind int, hi long, lo long, task int, lead boolean, n long, doc long, places array<int>"
_PLACES = pa.list_(pa.int32())


def lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def key(line: bytes) -> bytes:
    """bytes.lower changes A-Z alone, and no byte of a character beyond ASCII is white space."""
    return line.strip(BLANKS).lower()


def numbered(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc (a number for each row), doc_id, n_lines, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), (breaks + 1).cast("long").alias("n_lines"), text.alias("text"))
    return work.keep(rows, "documents", "zstd")


def _keys_of(chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("line_dedup")
        for batch in batches:
            for doc, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                places: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines(text.as_py())):
                    places.setdefault(key(line), []).append(at)
                kept = [k for k in places if len(k) >= chars and (chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= chars)]
                hashed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, kept)), "<i8").reshape(-1, 2)
                for a in range(0, len(kept), GATHERED):
                    some = kept[a : a + GATHERED]
                    same = np.ones(len(some), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashed[a : a + GATHERED, 0]), pa.array(hashed[a : a + GATHERED, 1]), pa.array([doc_id.as_py()] * len(some), pa.int64()), pa.array(same * doc.as_py()), pa.array([places[k] for k in some], _PLACES)],
                        names=["hi", "lo", "doc_id", "doc", "places"],
                    )
        give_back()

    return run


def line_keys(documents: DataFrame, chars: int = CHARS) -> DataFrame:
    """hi, lo, doc_id, doc, places: a row for each different key of a document."""
    return documents.select("doc", "doc_id", "text").mapInArrow(_keys_of(chars), "hi long, lo long, doc_id long, doc long, places array<int>")


class _Gathered:
    """Places to drop, gathered by document."""

    def __init__(self):
        self.docs, self.places, self.rows = [], [], 0

    def add(self, docs: np.ndarray, places: pa.Array) -> Iterator[pa.RecordBatch]:
        self.docs.append(docs)
        self.places.append(places)
        self.rows += len(docs)
        if self.rows >= GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        docs, places = np.concatenate(self.docs), pa.concat_arrays(self.places)
        order = np.argsort(docs, kind="stable")
        docs, places = docs[order], places.take(pa.array(order))
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        offsets = places.offsets.to_numpy()
        whole = pa.ListArray.from_arrays(pa.array(np.append(offsets[first], offsets[-1]).astype(np.int32)), places.values)
        yield _streamed(DROPPED, len(first), doc=docs[first], places=whole)
        self.__init__()


def _streamed(kind: int, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "hi": pa.int64(), "lo": pa.int64(), "task": pa.int32(), "lead": pa.bool_(), "n": pa.int64(), "doc": pa.int64(), "places": _PLACES}
    columns["kind"] = np.full(rows, kind, np.int32)
    made = [pa.nulls(rows, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays(made, names=list(kinds))


def _stream(least: int, spare_first: bool):
    """Sorted rows of line_keys to rows of _STREAMED: places to drop, rows left open at a border, counts of its keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("line_dedup")
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        gathered = _Gathered()
        held = None  # undecided rows of the last key
        seen = 0  # rows of the last key that went before those held
        first_key, last_key = None, None

        def left_open(rows: pa.RecordBatch, lead: np.ndarray) -> pa.RecordBatch:
            n = rows.num_rows
            return _streamed(OPEN, n, hi=rows.column(0), lo=rows.column(1), task=np.full(n, task, np.int32), lead=lead, doc=rows.column(2), places=rows.column(3))

        def count_of(k: tuple[int, int], n: int) -> pa.RecordBatch:
            return _streamed(COUNT, 1, hi=[k[0]], lo=[k[1]], task=[task], n=[n])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.select(["hi", "lo", "doc", "places"])
            if held is not None and held.num_rows:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            hi, lo, docs = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            if first_key is None:
                first_key = last_key = (int(hi[0]), int(lo[0]))
            before = np.zeros(len(starts), np.int64)
            if (int(hi[0]), int(lo[0])) == last_key:
                before[0] = seen
            elif last_key == first_key:  # the first key ended with the batch before, all its rows decided
                yield count_of(first_key, seen)
            sizes = np.diff(np.append(starts, len(hi)))
            run_of = np.repeat(np.arange(len(starts)), sizes)
            at_border = np.zeros(len(starts), bool)
            at_border[0] = (int(hi[0]), int(lo[0])) == first_key
            leads = np.zeros(len(hi), bool)
            leads[starts[before == 0]] = True
            many = before + sizes >= least
            drop = many[run_of]
            open_ = np.zeros(len(hi), bool)
            if at_border[0]:
                open_ |= (run_of == 0) & ~drop
                if spare_first:
                    open_ |= (run_of == 0) & leads
            stay = (run_of == len(starts) - 1) & ~drop  # wait for the next batch
            open_ &= ~stay
            if at_border[0] and len(starts) > 1:
                yield count_of(first_key, int(before[0] + sizes[0]))
            if open_.any():
                yield left_open(rows.filter(pa.array(open_)), leads[open_])
            gone = drop & ~open_
            if gone.any():
                places = rows.column(3).filter(pa.array(gone))
                if spare_first and (ahead := leads[gone]).any():
                    places = pa.array([p[1:] if lead else p for p, lead in zip(places.to_pylist(), ahead, strict=True)], _PLACES)
                yield from gathered.add(docs[gone], places)
            held = rows.filter(pa.array(stay))
            last_key, seen = (int(hi[-1]), int(lo[-1])), int(before[-1] + sizes[-1]) - held.num_rows
        if last_key is not None:
            yield count_of(last_key, seen + held.num_rows)
            if held.num_rows:
                lead = np.zeros(held.num_rows, bool)
                lead[0] = seen == 0
                yield left_open(held, lead)
        yield from gathered.flush()
        give_back()

    return run


def _bitmap(n: int, dropped: list[int] | None) -> bytes:
    if not dropped:
        return b""
    keep = np.ones(n, bool)
    keep[dropped] = False
    bits = np.packbits(keep, bitorder="little").tobytes()
    packed = zlib.compress(bits, 6)
    return b"\1" + packed if len(packed) < len(bits) else b"\0" + bits


def kept_lines(n: int, bitmap: bytes) -> np.ndarray:
    """True for each of n lines that the bitmap keeps."""
    if not bitmap:
        return np.ones(n, bool)
    bits = zlib.decompress(bitmap[1:]) if bitmap[:1] == b"\1" else bitmap[1:]
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n, bitorder="little").astype(bool)


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_bitmap(n, p) for n, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        lost = [len(p or ()) for p in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(lost, pa.int64()), pa.array(keep, pa.binary())], names=["doc", "doc_id", "n_lines", "n_dropped", "keep"])


def line_bitmaps(documents: DataFrame, work: Workspace, docs_at_least: int = DOCS_AT_LEAST, chars: int = CHARS, spare_first: bool = False) -> DataFrame:
    """doc, doc_id, n_lines, n_dropped, keep (bitmap) of every row of ``numbered`` documents."""
    keys = work.keep(line_keys(documents, chars), "line-keys")
    order = ["hi", "lo", F.col("doc_id").asc_nulls_last(), "doc"]
    streamed = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(docs_at_least, spare_first), _STREAMED)
    streamed = work.keep(streamed, "streamed")
    work.drop("line-keys")
    borders = streamed.where(F.col("kind") == COUNT).groupBy("hi", "lo").agg(F.sum("n").alias("total"), F.min("task").alias("first")).where(F.col("total") >= docs_at_least)
    spared = F.col("lead") & (F.col("task") == F.col("first")) if spare_first else F.lit(False)
    settled = streamed.where(F.col("kind") == OPEN).select("hi", "lo", "task", "lead", "doc", "places").join(borders, ["hi", "lo"])
    settled = settled.select("doc", F.when(spared, F.slice("places", 2, F.size("places"))).otherwise(F.col("places")).alias("places"))
    dropped = streamed.where(F.col("kind") == DROPPED).select("doc", "places").union(settled)
    dropped = dropped.groupBy("doc").agg(F.flatten(F.collect_list("places")).alias("places"))
    found = documents.select("doc", "doc_id", "n_lines").join(dropped, "doc", "left")
    return work.keep(found.mapInArrow(_bitmaps, "doc long, doc_id long, n_lines long, n_dropped long, keep binary"), "bitmaps")


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for n, keep, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if keep:
                text = b"\n".join(line for line, stays in zip(lines(text), kept_lines(n, keep), strict=True) if stays).decode("utf-8", "surrogatepass")
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "kept"])


def kept_text(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc, kept: the kept lines of documents, which lose some, joined by line breaks."""
    joined = documents.select("doc", "text").join(bitmaps.where("n_dropped > 0").select("doc", "n_lines", "keep"), "doc")
    return joined.select("doc", "n_lines", "keep", "text").mapInArrow(_kept, "doc long, kept string")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "line-dedup")
    documents = numbered(table(spark, sf_dir, "documents"), work)
    bitmaps = line_bitmaps(documents, work)
    changed = kept_text(documents, bitmaps).select("doc", F.sha2("kept", 256).alias("changed"))
    changed = work.keep(changed, "changed")
    whole = documents.select("doc", F.sha2("text", 256).alias("whole"))
    found = bitmaps.drop("keep").join(whole, "doc").join(changed, "doc", "left")
    return found.select("doc_id", "n_lines", "n_dropped", F.coalesce("changed", "whole").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, i, w[i] AS line, trim(translate(w[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, hot.k IS NOT NULL AS gone FROM l LEFT JOIN hot ON hot.k = l.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
