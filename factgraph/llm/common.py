"""What the operators share: table access, written intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_claims: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called by an operator's task in a Python worker. Workers live on from stage to stage, so what other operators
    keep in this one (word tables and the like) is cleared and handed back to the system."""
    others = [k for k in _claims if k != owner]
    for k in others:
        _claims.pop(k)()
    _claims[owner] = clear
    if others:
        give_back()


def give_back() -> None:
    """Free memory of this Python worker goes back to the system: idle workers stay alive beside those at work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Arrow batches lie in the JVM and in the worker at once; shuffle files are of no use once a table is written.
LEAN = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Plans run to their end inside pass small batches to Python and drop their shuffle files when they are done."""
    before = {k: spark.conf.get(k) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def named_apart(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sampled(share: float, *key: str | Column) -> Column:
    """Whether a row is among the ``share`` that a hash of its key chooses. All 64 bits of the hash count, so a share of
    any size, such as a few thousand rows of 10^13, is met."""
    return F.lit(True) if share >= 1 else F.xxhash64(*key) < F.lit(int(share * 2.0**64) - (1 << 63))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def kept_beside(keep: list[str], results: list[str]) -> list[str]:
    """``keep`` less the columns that bear a result's name in any case: the result takes their place."""
    taken = {r.lower() for r in results}
    return [c for c in keep if c.lower() not in taken]


def mapped(docs: DataFrame, keep: list[str], column: str, results: str, compute: Callable[[list], list[list]], owner: str, rows: int = 256) -> DataFrame:
    """The columns ``keep`` of docs and those of the DDL ``results``, which ``compute`` gives for lists of values of
    ``column`` as strings, a list for each result. Only positions tell columns apart, so no name of docs can clash."""
    kinds = T._parse_datatype_string(results).fields
    keep = kept_beside(keep, [f.name for f in kinds])
    plain = [f"c{i}" for i in range(len(keep))]
    columns = docs.select(*(quoted(c).alias(p) for c, p in zip(keep, plain, strict=True)), F.col(column).cast("string").alias("value"))
    out = T.StructType([*columns.schema.fields[:-1], *(T.StructField(f"r{i}", f.dataType) for i, f in enumerate(kinds))])
    arrow = to_arrow_schema(T.StructType(out.fields[len(keep) :]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = compute(part.column(len(keep)).to_pylist())
                found = [pa.array(g, arrow.field(i).type) for i, g in enumerate(got)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *found], names=out.names)
        give_back()

    return columns.mapInArrow(run, out).toDF(*keep, *(f.name for f in kinds))


class Workspace:
    """A folder of intermediate tables below ``spark.checkpoint.dir``, which every executor can read.

    Writing a table cuts the lineage: a lost executor repeats only what follows the last written table. The folder
    goes when the session ends, single tables earlier through ``drop``. Where the setting is absent (tests in local
    mode) a folder of the local machine stands in; on a cluster its absence is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file:///tmp/checkpoints"
        self.spark, self.path = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.deleteOnExit(self._hadoop)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df and return it as read back."""
        with lean(self.spark):
            df.write.option("compression", compression).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def connected_components(edges: DataFrame, work: Workspace, label: str = "cc", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternates the two star contractions of Kiveris et al. (2014): every node first hands its larger neighbours to
    its smallest neighbour, then its smaller ones. Each round is two aggregations and joins over the edges and is
    written, so nothing is gathered on the driver; the number of rounds grows with the logarithm of the path length.
    """
    edges = work.keep(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(),
        f"{label}-0",
    )
    seen = None
    for i in range(1, max_rounds + 1):
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), F.least("hi", "m").alias("m"))
        large = both.join(least, both.hi == least.k).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("k"), "m")
        small = large.join(least, large.hi == least.k)
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo")))
        edges = work.keep(small.where("hi <> lo").distinct(), f"{label}-{i}")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")).first()
        work.drop(f"{label}-{i - 1}")
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(tops.select("node", F.col("node").alias("component")))
