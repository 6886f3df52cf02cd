"""Operator 1: token-ID output in patched frame-of-reference blocks.

A corpus is a table of *segments*: each row holds the place of a run of documents in ascending doc_id order and one
self-contained ``payload``:

    magic 'PFB1' | u32 documents | u32 tokens | u32 blocks
    i64[documents] doc_id | u8[documents] doc_id is null | u32[documents] tokens of each document
    u32[blocks] block minimum | u8[blocks] width in bits | u32[blocks + 1] start of each block in the packed bytes
    u32[blocks + 1] start of each block in the exception lists
    packed bytes | u8[exceptions] position in the block | u32[exceptions] bits above the width

A block is BLOCK values; its minimum is subtracted, the differences are packed at the width that holds PERCENTILE of
them, and the high bits of the others stand in the exception list. The index of starts gives every block without
decoding those before it.

Rows: null text counts as empty (only the end id); null doc_ids sort first; equal doc_ids keep one record each,
ordered by their ids. An empty table gives no segments. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from struct import pack as packed

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, claim, give_back, lean, table

BLOCK = 128
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 16
MAGIC = b"PFB1"
#: Bytes of known words and their ids a task may hold, and of text it encodes at a time (a longer document stands alone).
CACHED_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
#: What a word and its ids cost beside their own bytes.
_ENTRY = 220


# ---- encoding -------------------------------------------------------------------------------------------------


#: Places between a Latin letter and an ASCII mark other than the apostrophe, either way round.
_BEFORE_MARK = "([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\\[-`{-~])"
_AFTER_MARK = "([!-&(-/:-@\\[-`{-~])([A-Za-zÀ-ÖØ-öø-ÿ])"


class _Recent(dict):
    """Values by word; at each renewal beyond half of ``most`` bytes, those not asked for since the last one go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.older = most, 0, {}

    def renew(self) -> None:
        if self.held > self.most // 2:
            self.older, self.held = dict(self), 0
            self.clear()

    def recall(self, word: str) -> bytes | None:
        found = self.older.pop(word, None)
        if found is not None:
            self[word] = found
        return found


class WordEncoder:
    """The ids a tokenizers file gives to whole texts, with the ids of each blank-separated word kept in memory.

    Sound for tokenizers whose pieces never span white space and do not depend on what stands before or behind a
    blank, as word BPE with word ends: the ids of a text are then those of its words in turn. Where the file says
    that case is dropped and runs of letters are pieces, capitals A-Z are made small and blanks put between letters
    and marks first (not in texts that may hold a special token), which changes no id and leaves far fewer different
    words. Unknown words are encoded by the library: letters many at a time, divided at the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said, vocabulary = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab()
        kinds = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        self.letters = "Lowercase" in kinds and r"[\p{L}]+" in json.dumps(said["pre_tokenizer"]).replace("\\\\", "\\")
        self.model = self.tokenizer.model
        self.direct = self.letters and said["model"]["type"] == "BPE" and '"ByteLevel"' in json.dumps(said["pre_tokenizer"])
        suffix = said["model"].get("end_of_word_suffix") or "</w>"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, k in vocabulary.items():
            self.ends[k] = piece.endswith(suffix)
        self.words = _Recent(CACHED_BYTES)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        words, tokenize, letters = self.words, self.model.tokenize, []
        for w in new:
            if not self.letters or not w.isalpha():
                words[w] = self._ids(w)
            elif self.direct and w.isascii() and w.islower():  # the same in the byte alphabet of such models: no need to normalise it
                words[w] = packed("<%dI" % len(found := [t.id for t in tokenize(w)]), *found)
            else:
                letters.append(w)
        for i in range(0, len(letters), 500):
            part = letters[i : i + 500]
            raw = self._ids(" ".join(part))
            stops = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
            if len(stops) == len(part):
                start = 0
                for w, stop in zip(part, stops.tolist(), strict=True):
                    words[w] = raw[4 * start : 4 * stop]
                    start = stop
            else:
                for w in part:
                    words[w] = self._ids(w)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words are split and numbered by Arrow, so that each different word of the batch is
        looked up once; all of them stay known until the batch is done."""
        known = self.words
        known.renew()
        flat = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        if self.letters:
            plain = pc.ascii_lower(flat)
            for place in (_BEFORE_MARK, _AFTER_MARK):
                plain = pc.replace_substring_regex(plain, place, r"\1 \2")
            flat = pc.if_else(pc.match_substring(flat, "<|"), flat, plain)
        split = pc.split_pattern(flat, " ")
        numbered = split.values.dictionary_encode()
        kinds, place = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        found = list(map(known.get, kinds))
        gaps = [i for i, x in enumerate(found) if x is None]
        self._learn([kinds[i] for i in gaps if known.recall(kinds[i]) is None])
        for i in gaps:
            found[i] = known[kinds[i]]
            known.held += _ENTRY + len(kinds[i]) + len(found[i])
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        sizes = size[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = pool[np.repeat(start[place] - ends[:-1], sizes) + np.arange(ends[-1])]
        marks = ends[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- blocks ---------------------------------------------------------------------------------------------------


def pack_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(minimum, width, starts, exception starts, packed bytes, exception positions, exception high bits)."""
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        zero = np.zeros(0, np.uint32)
        return zero, zero.astype(np.uint8), np.zeros(1, np.uint32), np.zeros(1, np.uint32), b"", zero.astype(np.uint8), zero
    pad = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1], np.uint32)]).reshape(blocks, BLOCK)
    low = pad.min(axis=1)
    diff = (pad - low[:, None]).astype(np.uint32)
    ranked = np.sort(diff, axis=1)[:, (BLOCK * PERCENTILE) // 100 - 1]
    width = np.zeros(blocks, np.uint8)
    width[ranked > 0] = np.floor(np.log2(ranked[ranked > 0])).astype(np.uint8) + 1
    size = width.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        wide = 2 if w <= 16 else 4  # bytes that hold the low bits
        bits = np.unpackbits(diff[rows].astype(f">u{wide}").view(np.uint8).reshape(len(rows), BLOCK, wide), axis=2)[:, :, 8 * wide - w :]
        packed[(starts[rows][:, None] + np.arange(w * BLOCK // 8)).ravel()] = np.packbits(bits.reshape(len(rows), -1), axis=1).ravel()
    high = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    at_block, at = np.nonzero(high)
    marks = np.concatenate([[0], np.cumsum(np.bincount(at_block, minlength=blocks))])
    return low, width, starts.astype(np.uint32), marks.astype(np.uint32), packed.tobytes(), at.astype(np.uint8), high[at_block, at]


def unpack_blocks(n: int, low: np.ndarray, width: np.ndarray, starts: np.ndarray, marks: np.ndarray, packed: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    blocks = len(low)
    diff = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        raw = packed[starts[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        wide = 2 if w <= 16 else 4
        bits = np.zeros((len(rows), BLOCK, 8 * wide), np.uint8)
        bits[:, :, 8 * wide - w :] = np.unpackbits(raw, axis=1).reshape(len(rows), BLOCK, w)
        diff[rows] = np.packbits(bits, axis=2).view(f">u{wide}").reshape(len(rows), BLOCK)
    block = np.repeat(np.arange(blocks), np.diff(marks.astype(np.int64)))
    diff[block, at] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (diff + low[:, None]).ravel()[:n]


def write_segment(ids: list[int | None], counts: list[int], values: np.ndarray) -> bytes:
    low, width, starts, marks, packed, at, high = pack_blocks(values)
    null = np.array([x is None for x in ids], np.uint8)
    return b"".join(
        [
            MAGIC,
            np.array([len(ids), len(values), len(low)], "<u4").tobytes(),
            np.array([x or 0 for x in ids], "<i8").tobytes(),
            null.tobytes(),
            np.array(counts, "<u4").tobytes(),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            starts.astype("<u4").tobytes(),
            marks.astype("<u4").tobytes(),
            packed,
            at.tobytes(),
            high.astype("<u4").tobytes(),
        ]
    )


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, tokens of each document, all token ids)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, n, blocks = np.frombuffer(payload, "<u4", 3, 4).tolist()
    place = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(payload, kind, count, place)
        place += out.nbytes
        return out

    ids, null, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    low, width, starts, marks = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1)
    packed = take("u1", int(starts[-1]))
    at, high = take("u1", int(marks[-1])), take("<u4", int(marks[-1]))
    values = unpack_blocks(n, low, width, starts, marks, packed, at, high)
    return [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)], counts, values


# ---- the operator ---------------------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts (column 1) hold BATCH_BYTES, or of one row."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.float64)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0.0
        stop = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode docs(doc_id, text) and write the segments to ``path``.

    Quantiles of doc_id, found on that column alone, cut the documents into ranges; each task encodes its texts where
    it reads them and only ids (two or four bytes each) are shuffled to their range, sorted and packed. ``start`` of
    a segment counts within its range; the offsets of the ranges, one row each, complete it when read.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = np.array(sorted(set(cuts)), dtype=np.float64)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_blocks")
        words = WordEncoder(tokenizer)  # of this task alone
        for batch in batches:
            for part in _slices(batch):
                ids, texts = part.column(0), part.column(1)
                key = np.searchsorted(cuts, np.array([float("-inf") if x is None else x for x in ids.to_pylist()], np.float64), side="left")
                values = words.encode_batch([t or "" for t in texts.to_pylist()])
                wide = [len(v) > 0 and int(v.max()) > 0xFFFF or end_id > 0xFFFF for v in values]
                kinds = ["<u4" if w else "<u2" for w in wide]
                raw = [v.astype(k).tobytes() + np.array([end_id], k).tobytes() for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), ids, pa.array(wide, pa.bool_()), pa.array(raw, pa.binary())], names=["part", "doc_id", "wide", "ids"])
                del ids, texts, values, raw, part
        del words
        give_back()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held, ids, counts, size = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([write_segment(ids, counts, values)], pa.binary())],
                names=["part", "start", "n_tokens", "payload"],
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                p, doc_id, wide, raw = (c[i].as_py() for c in columns)
                if ids and (p != part or size >= SEGMENT_TOKENS):
                    yield flush()
                    start, held, ids, counts, size = start + size, [], [], [], 0
                if p != part:
                    part, start = p, 0
                values = np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)
                held.append(values)
                ids.append(doc_id)
                counts.append(len(values))
                size += len(values)
        if ids:
            yield flush()

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "part int, doc_id long, wide boolean, ids binary")
    dealt = encoded.repartition(ranges, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    with lean(spark):
        dealt.mapInArrow(pack, "part int, start long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written segments; ``start`` counts all ids of the corpus before the segment."""
    found = spark.read.schema("part int, start long, n_tokens long, payload binary").parquet(path)
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each range
    before, offsets = 0, []
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets.append((row["part"], before))
        before += row["n"]
    known = spark.createDataFrame(offsets, "part int, before long")
    return found.join(F.broadcast(known), "part").select("part", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "payload")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (u32 little-endian) of every document, from the files."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1), strict=True):
                ids, counts, values = read_segment(payload.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                raw = values.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(start.as_py() + ends - counts, pa.int64()),
                        pa.array(counts.astype(np.int64), pa.int64()),
                        pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments(spark, path).select("start", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_corpus(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs as segments, read them back and return doc_id, start, n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = f"{Workspace(spark, 'token-blocks').path}/corpus"
    write_corpus(docs, path, tokenizer, end_id)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


__all__ = ["op1_token_blocks", "pack_blocks", "read_documents", "read_segment", "segments", "token_corpus", "unpack_blocks", "write_corpus", "write_segment"]
