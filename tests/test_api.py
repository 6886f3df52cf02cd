"""The graph from episodes to search and removal."""

from pyspark.sql import functions as F

from factgraph.plans.api import Judge, TemporalGraph


def test_life_of_a_graph(spark, tmp_path):
    g = TemporalGraph(spark, str(tmp_path / "graph"))
    stamp = lambda c: F.to_timestamp(F.lit(c))

    def batch(episode, day, nodes, edges):
        eps = spark.createDataFrame([(episode, "ep", "g")], "uuid string, name string, group_id string").withColumn("valid_at", stamp(day)).withColumn("created_at", stamp(day)).withColumn("content", F.lit("text"))
        n = spark.createDataFrame(nodes, "uuid string, name string").withColumn("group_id", F.lit("g")).withColumn("labels", F.array(F.lit("Person"))).withColumn("created_at", stamp(day))
        e = spark.createDataFrame(edges, "uuid string, source_node_uuid string, target_node_uuid string, name string, fact string").withColumn("group_id", F.lit("g"))
        e = e.withColumn("episodes", F.array(F.lit(episode))).withColumn("valid_at", stamp(day)).withColumn("created_at", stamp(day)).withColumn("invalid_at", F.lit(None).cast("timestamp")).withColumn("expired_at", F.lit(None).cast("timestamp"))
        g.add_episodes(eps, lambda _: (n, e), "2025-01-01", judge=Judge(contradicts=lambda pairs: pairs.where("fact <> new_fact").select("new_uuid", "uuid")))

    batch("ep1", "2024-01-01", [("n1", "Alice Smith"), ("n2", "Bob Jones"), ("n3", "alice  smith")], [("e1", "n3", "n2", "LIKES", "Alice likes Bob"), ("e0", "n1", "n2", "LIKES", "alice LIKES bob")])
    batch("ep2", "2024-02-01", [("m1", "ALICE SMITH"), ("m2", "Bob Jones")], [("e2", "m1", "m2", "DISLIKES", "Alice dislikes Bob")])
    assert {r.uuid for r in g.table("entities").collect()} == {"n1", "n2"}
    edges = {r.uuid: r for r in g.table("edges").collect()}
    assert set(edges) == {"e0", "e2"} and edges["e0"].invalid_at == edges["e2"].valid_at and edges["e0"].expired_at is not None
    assert {(r.source_node_uuid, r.target_node_uuid) for r in g.table("mentions").collect()} == {("ep1", "n1"), ("ep1", "n2"), ("ep2", "n1"), ("ep2", "n2")}
    assert [r.uuid for r in g.search("dislikes")["edges"].collect()] == ["e2"] and g.search("  ") == {}
    g.build_communities()
    assert g.table("communities").count() == 1 and g.table("members").count() == 2
    assert [r.uuid for r in g.retrieve_episodes("2024-01-15").collect()] == ["ep1"]
    g.export(str(tmp_path / "out"), "my graph")
    assert (tmp_path / "out" / "nodes_my_graph").is_dir()
    g.remove_episodes(g.table("episodes").where("uuid = 'ep2'"))
    assert {r.uuid for r in g.table("edges").collect()} == {"e0"} and g.table("entities").count() == 2
    g.clear(["g"])
    assert g.table("entities").count() == 0
