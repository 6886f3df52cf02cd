"""Embedding of texts by a callable, each different text once, through a cache of content."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts to their vectors, in order; runs in the tasks.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 64
_CACHED = "key string, vector array<double>"


def content_key(model: str, text: str):
    """Column of the key under which a text's vector is kept: model and text by MD5."""
    return F.md5(F.concat(F.lit(f"{model}:"), F.col(text)))


def _vectors(embed: Embedder, batch_size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                got = embed(part.column(1).to_pylist())
                if len(got) != part.num_rows:
                    raise ValueError(f"{len(got)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float64()))], names=["key", "vector"])

    return run


class EmbeddingCache:
    """Vectors by key in a folder all executors share. Every call adds a folder of what was missing, written as a whole or
    not at all; two calls at one time may both embed a text, of which one vector is read."""

    def __init__(self, spark, path: str, model: str, embed: Embedder, batch_size: int = BATCH):
        self.spark, self.path, self.model, self.embed, self.batch_size = spark, path.rstrip("/"), model, embed, batch_size

    def known(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        done = [str(s.getPath()) for s in fs.listStatus(folder) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(folder) else []
        if not done:
            return self.spark.createDataFrame([], _CACHED)
        return self.spark.read.schema(_CACHED).parquet(*done)

    def embedded(self, rows: DataFrame, text: str, column: str) -> DataFrame:
        """rows with the vector of their text as ``column``, null for null texts. Only texts that the cache lacks are embedded."""
        asked = rows.where(F.col(text).isNotNull()).select(content_key(self.model, text).alias("key"), F.col(text).alias("text"))
        missing = asked.groupBy("key").agg(F.min("text").alias("text")).join(self.known().select("key"), "key", "left_anti")
        missing.mapInArrow(_vectors(self.embed, self.batch_size), _CACHED).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        known = self.known().groupBy("key").agg(F.first("vector").alias(column))
        return rows.withColumn("__key", content_key(self.model, text)).drop(column).join(known.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
