"""Splitting texts: recursive chunks with overlap, fixed windows, paragraphs packed by bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, size: int = 1000, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters. The first separator present cuts the text, pieces that are still too long
    are cut by the next ones, and neighbouring pieces are joined again up to the size, each chunk beginning with the
    last whole pieces of the one before within ``overlap``."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark = separators[at]
    pieces = list(text) if mark == "" else [p if i == 0 else mark + p for i, p in enumerate(text.split(mark)) if p or i]
    out: list[str] = []
    held: list[str] = []

    def join() -> None:
        nonlocal held
        held, done = held, []
        length = 0
        window: list[str] = []
        for p in held:
            if length + len(p) > size and window:
                done.append("".join(window))
                while window and (length > overlap or length + len(p) > size):
                    length -= len(window.pop(0))
            window.append(p)
            length += len(p)
        if window:
            done.append("".join(window))
        out.extend(x.strip() for x in done if x.strip())
        held = []

    for p in pieces:
        if len(p) <= size:
            held.append(p)
        else:
            join()
            out.extend(split_recursive(p, size, overlap, separators[at + 1 :] or ("",)))
    join()
    return out


def pack_paragraphs(text: str, most: int = 100_000) -> list[str]:
    """Paragraphs joined while their UTF-8 stays within ``most`` bytes; longer ones are cut at blanks, or within a word if need be."""
    out: list[str] = []
    now, size = "", 0
    for paragraph in text.split("\n\n"):
        for part in _cut(paragraph, most):
            n = len(part.encode("utf-8", "surrogatepass"))
            if now and size + 2 + n > most:
                out.append(now)
                now, size = "", 0
            now, size = (f"{now}\n\n{part}", size + 2 + n) if now else (part, n)
    return [*out, now] if now else out


def _cut(text: str, most: int) -> Iterator[str]:
    raw = text.encode("utf-8", "surrogatepass")
    while len(raw) > most:
        end = most
        while end > 0 and raw[end] & 0xC0 == 0x80:
            end -= 1
        blank = raw.rfind(b" ", 0, end)
        end = blank if blank > 0 else max(end, 1)
        if part := raw[:end].decode("utf-8", "surrogatepass").rstrip():
            yield part
        raw = raw[end:].lstrip()
    if raw:
        yield raw.decode("utf-8", "surrogatepass")


def split_column(df: DataFrame, key: str, text: str, split) -> DataFrame:
    """(key, position, chunk): ``split`` on every text, whole, in Arrow batches."""
    columns = df.select(key, F.col(text).cast("string").alias("__t"))
    kind = columns.schema.fields[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, places, chunks = [], [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    got = split(t or "")
                    keys += [k] * len(got)
                    places += range(len(got))
                    chunks += got
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), pa.array(places, pa.int64()), pa.array(chunks, pa.string())], names=[key, "position", "chunk"])

    return columns.mapInArrow(run, f"`{key}` {kind}, position long, chunk string")


def chunk_estimate(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """About how many chunks a text makes."""
    return F.ceil(F.length(text) / float(size - overlap))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(key, position, chunk): windows of ``size`` characters every ``size - overlap``, in the JVM."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int"), F.lit(1)) - 1
    rows = df.where(F.length(text) > 0).select(key, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), last)).alias("position"))
    return rows.select(key, F.col("position").cast("long").alias("position"), F.substr("__t", F.col("position") * step + 1, F.lit(size)).alias("chunk"))
