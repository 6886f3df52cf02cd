"""The graph tables as views of the star-schema test tables, so that every operator has rows and a SQL check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.functions import vectors as V


class Bound:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))

    def entities(self) -> DataFrame:
        def kind(table: str, letter: str, key: str, name: str, label: str, group: Column, summary: Column) -> DataFrame:
            return self.table(table).select(
                F.concat(F.lit(letter), F.col(key)).alias("uuid"), F.col(name).alias("name"), F.array(F.lit("Entity"), F.lit(label)).alias("labels"), group.alias("group_id"), summary.alias("summary")
            )

        return (
            kind("customer", "c", "c_custkey", "c_name", "Customer", F.concat(F.lit("g"), F.col("c_nationkey") % 3), F.col("c_mktsegment"))
            .unionByName(kind("part", "p", "p_partkey", "p_name", "Part", F.lit("g0"), F.col("p_type")))
            .unionByName(kind("supplier", "s", "s_suppkey", "s_name", "Supplier", F.concat(F.lit("g"), F.col("s_nationkey") % 3), F.lit("supplier")))
        )

    def edges(self) -> DataFrame:
        """Facts: a customer's order of a part; equal rows of one order line number make one fact."""
        li = self.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_shipdate").alias("l_shipdate"), F.max("l_returnflag").alias("l_returnflag"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.concat(F.lit("e"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey").alias("uuid"),
            F.concat(F.lit("c"), "o_custkey").alias("source_node_uuid"),
            F.concat(F.lit("p"), "l_partkey").alias("target_node_uuid"),
            F.concat(F.lit("ORDERED_"), "l_returnflag").alias("name"),
            F.concat(F.lit("g"), F.col("o_custkey") % 3).alias("group_id"),
            F.col("o_orderdate").alias("valid_at"),
            F.col("l_shipdate").alias("created_at"),
            F.array(F.concat(F.lit("o"), "l_orderkey")).alias("episodes"),
        )

    def ended_edges(self) -> DataFrame:
        """edges with invalid_at: the next order of the same part by the same customer."""
        from pyspark.sql import Window

        w = Window.partitionBy("source_node_uuid", "target_node_uuid").orderBy("valid_at", "uuid")
        return self.edges().withColumn("invalid_at", F.lead("valid_at").over(w))

    def facts(self) -> DataFrame:
        """edges with the sentence they state."""
        e = self.edges()
        c = self.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_node_uuid"), "c_name")
        p = self.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("target_node_uuid"), "p_name")
        return e.join(c, "source_node_uuid").join(p, "target_node_uuid").withColumn("fact", F.concat("c_name", F.lit(" ordered "), "p_name")).drop("c_name", "p_name")

    def vector_edges(self) -> DataFrame:
        """Few facts with embeddings."""
        v = self.table("embeddings")
        return v.select(
            F.concat(F.lit("f"), "vec_id").alias("uuid"),
            F.concat(F.lit("c"), F.col("vec_id") % 50).alias("source_node_uuid"),
            F.concat(F.lit("p"), "label").alias("target_node_uuid"),
            F.concat(F.lit("g"), F.col("label") % 3).alias("group_id"),
            F.concat_ws(" ", F.lit("fact"), F.col("vec_id") % 7, F.lit("about"), "label").alias("fact"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.sequence(F.lit(0), F.col("vec_id") % 3).cast("array<string>").alias("episodes"),
        )

    def close_vectors(self, share: float) -> DataFrame:
        """The embeddings as unit vectors moved towards that of vec_id 0 by ``share``, so that likenesses reach high thresholds."""
        v, q = V.l2_normalize(F.col("embedding").cast("array<double>")), V.l2_normalize(V.literal(self.query_vector()))
        return self.table("embeddings").withColumn("embedding", F.zip_with(v, q, lambda x, y: x + F.lit(share) * y))

    def links(self, status: str | None = None) -> DataFrame:
        """Edges between customers, from orders."""
        o = self.table("orders")
        o = o.where(F.col("o_orderstatus") == status) if status else o
        return o.select(
            F.concat(F.lit("a"), "o_orderkey").alias("uuid"), F.concat(F.lit("c"), "o_custkey").alias("source_node_uuid"), F.concat(F.lit("c"), (F.col("o_custkey") * 3 + F.col("o_orderkey")) % 1500).alias("target_node_uuid")
        )

    def label_communities(self) -> DataFrame:
        """A community for each label of the embeddings, with their mean."""
        means = self.table("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
        rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
        return rows.select(F.concat(F.lit("l"), "label").alias("uuid"), F.concat(F.lit("brand "), "label").alias("name"), "embedding")

    def long_names(self) -> DataFrame:
        """uuid, name, k of the parts by name, type and brand."""
        return self.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"), F.col("p_partkey").alias("k"))

    def vector_nodes(self) -> DataFrame:
        v = self.table("embeddings").select(F.concat(F.lit("c"), "vec_id").alias("uuid"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
        return v.join(self.entities(), "uuid")

    def query_vector(self) -> list[float]:
        """The embedding of vec_id 0."""
        return [float(x) for x in self.table("embeddings").where("vec_id = 0").select("embedding").first()[0]]

    def episodes(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("v"), "event_id").alias("uuid"), F.concat(F.lit("u"), "user_id").alias("group_id"), F.col("event_type").alias("source"), F.col("ts").alias("valid_at"), F.col("props").alias("content")
        )

    def order_episodes(self) -> DataFrame:
        return self.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uuid"), F.concat(F.lit("g"), F.col("o_custkey") % 3).alias("group_id"), F.col("o_orderdate").alias("valid_at"), F.col("o_orderstatus").alias("source"))

    def messages(self) -> DataFrame:
        return self.table("conversations").select(F.concat(F.lit("m"), "conv_id", F.lit("_"), "turn").alias("uuid"), F.concat(F.lit("k"), "conv_id").alias("group_id"), F.col("text").alias("content"), F.col("role").alias("source"), "turn")

    def mentions(self) -> DataFrame:
        return self.table("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_node_uuid"), F.concat(F.lit("p"), "l_partkey").alias("target_node_uuid")).distinct()

    def communities(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("k"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("uuid"), F.concat(F.lit("brand "), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("name"), F.lit("g0").alias("group_id")).distinct()

    def members(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("k"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("source_node_uuid"), F.concat(F.lit("p"), "p_partkey").alias("target_node_uuid"))

    def part_names(self) -> DataFrame:
        """uuid, name of the parts."""
        return self.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.col("p_name").alias("name"))

    def name_counts(self) -> DataFrame:
        """(name, count): part names as relation names, IS_ before every second one."""
        return self.table("part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("IS_")).otherwise(F.lit("")), F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("count"))

    def relation_rows(self) -> DataFrame:
        """name: two neighbouring words of the documents, in small letters."""
        w = T.tokens(F.col("text"))
        return self.table("documents").select(w.alias("w")).where("size(w) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit("_"), F.element_at("w", i + 1)))).alias("name"))

    def mapping(self) -> DataFrame:
        """(cluster_id, name, count): part names clustered by their first word."""
        n = self.name_counts()
        return n.select(F.substring_index(F.replace("name", F.lit("IS_"), F.lit("")), "_", 1).alias("cluster_id"), "name", "count")
