"""Readers of files: texts, tables with any separator, cluster files, run logs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files: UTF-8, or Latin-1 where the bytes are not; empty files raise an error when read."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    as_text = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.when(F.length(F.trim(text)) > 0, text).otherwise(F.raise_error(F.concat(F.lit("empty file: "), "path"))).alias("text"))


def numbered_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(number, path, text) of the files ``<number>_<name>.txt`` of a folder."""
    rows = texts(spark, f"{folder.rstrip('/')}/*.txt")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(name.rlike(r"^\d+_.*\.txt$")).select(F.regexp_extract(name, r"^(\d+)_", 1).cast("int").alias("number"), "path", "text").orderBy("number")


def merged_text(rows: DataFrame) -> DataFrame:
    """One text of rows(number, text), in order, with line breaks between."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n").alias("text"))


def write_merged(rows: DataFrame, folder: str) -> None:
    """The texts of rows(number, text) in order as text files, a line break behind each: the parts one after another are
    the corpus, which no task holds whole."""
    rows.orderBy("number").select("text").write.mode("overwrite").text(folder)


def separated(spark: SparkSession, path: str, separator: str | None = None, times: Sequence[str] = ()) -> DataFrame:
    """A table with a header, all columns text but ``times``, 'Unnamed: 0' dropped. Without a separator it is found in the
    header line: a tab, else a comma. Empty cells are null, and so are times that cannot be read."""
    if separator is None:
        first = spark.read.text(path).limit(1).collect()
        separator = "\t" if first and "\t" in first[0]["value"] else ","
    df = spark.read.option("sep", separator).option("header", True).option("nullValue", "").csv(path)
    return df.drop("Unnamed: 0").withColumns({c: F.try_to_timestamp(F.col(c)) for c in times})


def by_threshold(spark: SparkSession, pattern: str) -> DataFrame:
    """Tables of a glob with ``threshold`` from the end of the file name, null if there is none."""
    df = spark.read.option("header", True).csv(pattern)
    return df.withColumn("threshold", F.regexp_extract(F.input_file_name(), r"_([0-9]+(?:\.[0-9]+)?)\.csv$", 1).try_cast("double"))


def _opened(path: str):
    """The zip archive at a path or URI that every executor can read."""
    import os
    import zipfile

    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))
    return zipfile.ZipFile(system.open_input_file(place))


def _array_header(stream) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of the array whose numbers follow in the stream."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(stream)
    if kind.hasobject or (by_column and len(shape) > 1):
        raise ValueError("names and embeddings must be plain arrays by rows")
    return shape, kind


def npz_embeddings(spark: SparkSession, path: str, block: int = 16_384) -> DataFrame:
    """(name, embedding) of a numpy archive of names and embeddings, at a path or URI that every executor can read; a name
    that comes twice keeps its last one.

    The driver reads the two headers. Tasks read ``block`` rows each, straight from their place in a stored archive; a
    compressed one cannot be entered in the middle, so one task reads it as a stream of blocks.
    """
    with _opened(path) as archive:
        with archive.open("names.npy") as names, archive.open("embeddings.npy") as vectors:
            (count, *_), (rows, width), stored = _array_header(names)[0], _array_header(vectors)[0], archive.getinfo("embeddings.npy").compress_type == 0
    if count != rows:
        raise ValueError(f"{count} names and {rows} embeddings")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(path) as archive, archive.open("names.npy") as names, archive.open("embeddings.npy") as vectors:
                    kinds = [_array_header(f)[1] for f in (names, vectors)]
                    names.seek(first * kinds[0].itemsize, 1)
                    vectors.seek(first * width * kinds[1].itemsize, 1)
                    for at in range(first, last, block):
                        n = min(block, last - at)
                        who = np.frombuffer(names.read(n * kinds[0].itemsize), kinds[0])
                        what = np.frombuffer(vectors.read(n * width * kinds[1].itemsize), kinds[1]).astype(np.float64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(what))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array([str(x) for x in who.tolist()], pa.string()), lists], names=["place", "name", "embedding"])

    step = block if stored else max(rows, 1)
    ranges = spark.range(0, rows, step, max(1, -(-rows // step))).select(F.col("id").alias("first"), F.least(F.col("id") + step, F.lit(rows)).alias("last"))
    found = ranges.mapInArrow(read, "place long, name string, embedding array<double>")
    return found.groupBy("name").agg(F.max_by("embedding", "place").alias("embedding"))


def cluster_file(existing: list[str], threshold: float) -> str | None:
    """The first of the usual names for a threshold among existing files."""
    for kind in ("merged", "collapsed"):
        for form in ("{:.2f}", "{:.1f}", "{:.0f}"):
            name = f"{kind}_sim_{form.format(threshold)}.csv"
            if name in existing:
                return name
    return None


def run_status(spark: SparkSession, path: str) -> DataFrame:
    """(path, started_at, chunk, chunks, elapsed_s) from status files of lines 'started_at: ..' and 'chunk: i/n elapsed_s: t'."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    last = F.element_at(F.regexp_extract_all("value", F.lit(r"chunk: \d+/\d+ elapsed_s: [0-9.]+"), F.lit(0)), -1)
    rows = rows.withColumn("last", F.when(F.size(F.regexp_extract_all("value", F.lit(r"chunk: \d+/\d+ elapsed_s: [0-9.]+"), F.lit(0))) > 0, last))
    part = lambda i: F.regexp_extract("last", r"chunk: (\d+)/(\d+) elapsed_s: ([0-9.]+)", i)
    return rows.select("path", F.regexp_extract("value", r"started_at: (\S+)", 1).alias("started_at"), part(1).try_cast("int").alias("chunk"), part(2).try_cast("int").alias("chunks"), part(3).try_cast("double").alias("elapsed_s"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def run_configuration(spark: SparkSession, path: str) -> DataFrame:
    """(path, chunk_size, chunk_overlap) of the text splitter from configuration files of JSON; null where a file says neither."""
    rows = spark.read.option("wholetext", True).text(path)
    part = lambda name: F.get_json_object("value", f"$.text_splitter.{name}").try_cast("int").alias(name)
    return rows.select(F.input_file_name().alias("path"), part("chunk_size"), part("chunk_overlap"))


def parse_thresholds(text: str | None, distances: bool = False) -> list[float]:
    """'0.1,0.5' or 'low:high:step' as similarities; 0.1 to 1.0 by 0.1 without a text. Distances are turned round."""
    if not text:
        found = [round(0.1 * i, 2) for i in range(1, 11)]
    elif ":" in text:
        low, high, step = map(float, text.split(":"))
        found = [round(low + step * i, 6) for i in range(int(round((high - low) / step)) + 1)]
    else:
        found = [float(x) for x in re.split(r"[,\s]+", text.strip())]
    return [round(1 - x, 6) for x in found] if distances else found
