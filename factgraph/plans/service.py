"""What a service in front of the graph does: messages in, facts out, deletes by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.operators import filters, store
from factgraph.plans.api import Extractor, Judge, TemporalGraph


def add_messages(graph: TemporalGraph, messages: DataFrame, extract: Extractor, now: str, judge: Judge = Judge()) -> None:
    """Messages(uuid, group_id, role_type, role, content, timestamp) as episodes, of the text 'role(role_type): content'."""
    said = F.concat(F.coalesce("role", F.lit("")), F.lit("("), "role_type", F.lit("): "), "content")
    rows = messages.select("uuid", F.coalesce("name", F.lit("")).alias("name") if "name" in messages.columns else F.lit("").alias("name"), "group_id", said.alias("content"), F.lit("message").alias("source"))
    stamped = rows.join(messages.select("uuid", F.col("timestamp").alias("valid_at"), F.col("timestamp").alias("created_at")), "uuid")
    graph.add_episodes(stamped, extract, now, judge=judge)


def search_facts(graph: TemporalGraph, query: str, groups: list[str] | None = None, most: int = 10, vector: list[float] | None = None) -> DataFrame:
    """The facts that a hybrid search of the groups finds, with their score, best first."""
    found = graph.search(query, vector, "edges_rrf", filters.SearchFilters(group_ids=groups or []))
    facts = filters.fact_results(graph.table("edges"))
    if "edges" not in found:
        return facts.withColumn("score", F.lit(0.0)).limit(0)
    return facts.join(found["edges"].limit(most), "uuid").orderBy(F.desc("score"), "uuid")


def memory(graph: TemporalGraph, messages: DataFrame, group: str, most: int = 10) -> DataFrame:
    """Facts for a conversation messages(ord, role_type, role, content): its lines are the query."""
    line = F.concat("role_type", F.lit("("), F.coalesce("role", F.lit("")), F.lit("): "), "content")
    lines = messages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("q")).first()["q"]
    return search_facts(graph, lines or "", [group], most)


def fact(graph: TemporalGraph, uuid: str) -> DataFrame:
    return filters.fact_results(graph.table("edges").where(F.col("uuid") == uuid))


def last_episodes(graph: TemporalGraph, group: str, last_n: int, until: str) -> DataFrame:
    return graph.retrieve_episodes(until, last_n, [group])


def delete_fact(graph: TemporalGraph, uuid: str) -> None:
    graph.delete("edges", graph.spark.createDataFrame([(uuid,)], "uuid string"))


def delete_group(graph: TemporalGraph, group: str) -> None:
    graph.clear([filters.check_group_id(group)])


def delete_episode(graph: TemporalGraph, uuid: str) -> None:
    graph.remove_episodes(graph.table("episodes").where(F.col("uuid") == uuid))


def save_entity(graph: TemporalGraph, uuid: str, group: str, name: str, summary: str = "") -> None:
    row = graph.spark.createDataFrame([(uuid, name, group, summary)], "uuid string, name string, group_id string, summary string")
    row = row.withColumn("created_at", F.current_timestamp()).withColumn("labels", F.array().cast("array<string>")).withColumn("summary", T.clean_input(F.col("summary")))
    graph.upsert("entities", store.with_label(row))
