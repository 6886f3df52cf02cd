"""Incremental ingestion by Structured Streaming: each micro-batch is merged into the graph tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factgraph.operators import store


class TableState:
    """A Parquet table in buckets of its keys and in generations. A batch writes the next generation of the buckets it
    touches and of no others; reading takes the newest generation of each. A batch that is run again after a failure
    writes the same generation from the same ones before. What two newer generations have replaced is removed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _path(self, tail: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}{tail}")

    def _written(self) -> dict[int, list[int]]:
        """Generations that hold each bucket, rising."""
        fs = self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found: dict[int, list[int]] = {}
        if fs.exists(self._path()):
            for g in fs.listStatus(self._path()):
                if g.getPath().getName().startswith("g-") and fs.exists(self._path(f"/{g.getPath().getName()}/_SUCCESS")):
                    for part in fs.listStatus(g.getPath()):
                        if part.getPath().getName().startswith("bucket="):
                            found.setdefault(int(part.getPath().getName()[7:]), []).append(int(g.getPath().getName()[2:]))
        return {k: sorted(v) for k, v in found.items()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        paths = []
        for bucket, generations in sorted(self._written().items()):
            known = [g for g in generations if before is None or g < before]
            if known and (only is None or bucket in only):
                paths.append(f"{self.path}/g-{known[-1]}/bucket={bucket}")
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, generation: int, key: str = "uuid") -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
        old = self.read(before=generation, only=touched)
        merged = batch if old is None else store.upsert(old, batch, key)
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/g-{generation}")
        fs = self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for b, generations in self._written().items():
            for g in [g for g in generations if g < generation][:-1]:  # the last one before this is read if it runs again
                fs.delete(self._path(f"/g-{g}/bucket={b}"), True)


def last_by_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``: a key that comes twice in a batch ends as its last row."""
    others = [c for c in batch.columns if c not in (key, order)]
    return batch.groupBy(key).agg(F.max(F.struct(order, *others)).alias("__m")).select(key, "__m.*")


def ingest(stream: DataFrame, state: TableState, checkpoint: str, order: str = "created_at", transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge a stream of rows with uuids into the state until what is available has been read."""

    def batch(df: DataFrame, number: int) -> None:
        rows = transform(df) if transform else df
        state.merge(last_by_key(rows, "uuid", order), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Rows of each day; a day is given out once ``late`` has passed after it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "n")
