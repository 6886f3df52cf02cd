"""Cutting the lineage of loops in a folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Lineage:
    """Writes a round's result below ``spark.checkpoint.dir`` and reads it back, so a lost executor repeats one round."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file:///tmp/checkpoints"
        self.spark, self.path, self.count = spark, f"{base.rstrip('/')}/lineage-{uuid.uuid4().hex}", 0
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(f"{self.path}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.count}")
