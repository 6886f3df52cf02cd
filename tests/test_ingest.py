"""Ingest, triplets, communities, search by recipe, service and streams of the graph."""

import pytest
from pyspark.sql import functions as F

from factgraph.__main__ import main
from factgraph.operators import canon, filters, graph, report, resolve, search, store
from factgraph.plans import service
from factgraph.plans.api import Judge, TemporalGraph
from factgraph.plans.lineage import Lineage
from factgraph.sources import npz_embeddings
from factgraph.streaming import TableState


def stamp(c):
    return F.to_timestamp(F.lit(c))


def people(spark, rows, day="2024-01-01"):
    return spark.createDataFrame(rows, "uuid string, name string, group_id string").withColumn("labels", F.array(F.lit("Person"))).withColumn("created_at", stamp(day))


def facts(spark, rows, day):
    e = spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, name string, fact string, episodes array<string>").withColumn("group_id", F.lit("g"))
    return e.withColumn("valid_at", stamp(day)).withColumn("created_at", stamp(day)).withColumn("invalid_at", F.lit(None).cast("timestamp")).withColumn("expired_at", F.lit(None).cast("timestamp"))


def add(g, spark, episode, day, nodes, edges, **more):
    eps = spark.createDataFrame([(episode, "ep", "g", "text")], "uuid string, name string, group_id string, content string").withColumn("valid_at", stamp(day)).withColumn("created_at", stamp(day))
    g.add_episodes(eps, lambda _: (people(spark, nodes, day), facts(spark, edges, day)), "2025-01-01", **more)


@pytest.fixture()
def g(spark, tmp_path):
    return TemporalGraph(spark, str(tmp_path / "graph"))


ENDS = [("a", "Alice Smith", "g"), ("b", "Bob Jones", "g")]


def test_reused_facts_gather_episodes_and_outlive_one(g, spark):
    add(g, spark, "ep1", "2024-01-01", ENDS, [("e1", "a", "b", "LIKES", "Alice likes Bob", ["ep1"])])
    add(g, spark, "ep2", "2024-02-01", [("a2", "alice smith", "g"), ("b2", "bob  jones", "g")], [("e2", "a2", "b2", "LIKES", "ALICE likes  bob", ["ep2"])])
    rows = g.table("edges").collect()
    assert [(r.uuid, r.episodes) for r in rows] == [("e1", ["ep1", "ep2"])]
    g.remove_episodes(g.table("episodes").where("uuid = 'ep2'"))
    assert g.table("edges").count() == 1


def test_copies_in_one_episode_keep_all_episodes(g, spark):
    add(g, spark, "ep1", "2024-01-01", ENDS, [("e1", "a", "b", "LIKES", "Alice likes Bob", ["ep1"]), ("e2", "a", "b", "LIKES", "alice likes bob", ["ep0"])])
    assert [sorted(r.episodes) for r in g.table("edges").collect()] == [["ep0", "ep1"]]


def opposite(pairs):
    """A judge to whom likes and hates contradict each other."""
    kind = lambda c: F.regexp_extract(c, "(likes|hates)", 1)
    return pairs.where((kind("fact") != "") & (kind("new_fact") != "") & (kind("fact") != kind("new_fact"))).select("new_uuid", "uuid")


def test_late_facts_come_expired(g, spark):
    add(g, spark, "ep2", "2024-03-01", ENDS, [("e2", "a", "b", "HATES", "Alice hates Bob", ["ep2"])])
    add(g, spark, "ep1", "2024-01-01", ENDS, [("e1", "a", "b", "LIKES", "Alice likes Bob", ["ep1"])], judge=Judge(contradicts=opposite))
    rows = {r.uuid: r for r in g.table("edges").collect()}
    assert rows["e1"].invalid_at == rows["e2"].valid_at and rows["e1"].expired_at is not None
    assert rows["e2"].invalid_at is None and rows["e2"].expired_at is None


def test_custom_types_only_where_allowed(g, spark):
    kinds = spark.createDataFrame([("Person", "Place", "LIVES_IN")], "src_label string, dst_label string, edge_type string")
    add(g, spark, "ep1", "2024-01-01", ENDS, [("e1", "a", "b", "LIVES_IN", "Alice lives in Bob", ["ep1"])], type_map=kinds, custom_types=["LIVES_IN"])
    assert [r.name for r in g.table("edges").collect()] == ["RELATES_TO"]


def test_add_triplet(g, spark):
    add(g, spark, "ep1", "2024-01-01", ENDS, [("e1", "a", "b", "LIKES", "Alice likes Bob", ["ep1"])])
    edge = facts(spark, [("t1", "x", "y", "KNOWS", "Alice knows Carol", [])], "2024-05-01")
    g.add_triplet(people(spark, [("x", "ALICE SMITH", "g")]), edge, people(spark, [("y", "Carol Brown", "g")]), "2025-01-01")
    rows = {r.uuid: (r.source_node_uuid, r.target_node_uuid) for r in g.table("edges").collect()}
    assert rows == {"e1": ("a", "b"), "t1": ("a", "y")} and {r.uuid for r in g.table("entities").collect()} == {"a", "b", "y"}


def test_safeguards_keep_places_apart(spark):
    kind = "uuid string, name string, kind string, hints array<string>, own string"
    old = spark.createDataFrame([("o1", "Paris", "Location", ["usa"], None), ("o2", "Paris", "Location", ["france"], None), ("o3", "Ann Lee", "People", [], "ann lee")], kind)
    new = spark.createDataFrame([("n1", "paris", "Location", ["france"], None), ("n2", "Paris", "Location", ["italy"], None), ("n3", "ann lee", "People", [], "ann b. lee"), ("n4", "paris", "Location", [], None)], kind)
    got = {r.uuid: (r.canonical, r.reason) for r in resolve.resolve(new, old).collect()}
    assert got == {"n1": ("o2", "exact_geo"), "n4": ("o1", "exact_geo_hint_partial")}


def test_communities_by_group(g, spark):
    nodes = [(f"{k}{i}", f"name {k} {i}", k) for k in "gh" for i in range(25)]
    edges = [(f"e{k}{i}", f"{k}0", f"{k}{i}", "R", f"{k}0 to {k}{i}", ["ep1"]) for k in "gh" for i in range(1, 25)] * 2 + [("x", "g0", "h0", "R", "across", ["ep1"])]
    add(g, spark, "ep1", "2024-01-01", nodes, [(f"{e[0]}_{i}", *e[1:4], f"{e[4]} {i}", e[5]) for i, e in enumerate(edges)])
    g.build_communities(lambda c: c)
    rows = g.table("communities").collect()
    assert sorted(r.group_id for r in rows) == ["g", "h"] and all(len(r.summary.split(", ")) == 25 for r in rows)
    add(g, spark, "ep2", "2024-02-01", [("new", "somebody new", "g"), ("g0", "name g 0", "g")], [("en", "new", "g0", "R", "new to g0", ["ep2"])])
    g.update_communities(g.table("entities").where("uuid = 'new'"), lambda c: c)
    assert g.table("members").where("target_node_uuid = 'new'").first().group_id == "g"
    grown = g.table("members").where("target_node_uuid = 'new'").first().source_node_uuid
    assert g.table("communities").where(F.col("uuid") == grown).first().summary.endswith(", somebody new")
    g.remove_communities()
    assert g.table("communities").count() == 0


def test_search_by_recipe(g, spark):
    add(g, spark, "ep1", "2024-01-01", [*ENDS, ("c", "Carol Red", "g")], [("e1", "a", "b", "LIKES", "Alice likes red", ["ep1"]), ("e2", "b", "c", "LIKES", "Bob likes red wine", ["ep1", "ep2"]), ("e3", "c", "a", "SEES", "other words", ["ep1"])])
    one = lambda r, **more: [x.uuid for x in g.search("red", recipe=r, **more)["edges"].collect()]
    assert one("edges_rrf") == ["e1", "e2"] and one("edges_episode_mentions") == ["e2", "e1"]
    assert one("edges_node_distance", center="b") == ["e2", "e1"]
    assert "e3" in one("edges_cross_encoder")  # found by traversal only
    with pytest.raises(ValueError):
        one("edges_node_distance")
    with pytest.raises(ValueError):
        g.search("red", recipe="edges_mmr")
    with pytest.raises(ValueError):
        search.hybrid(g.table("communities"), "x", None, ["name"], None, search.Recipe(reranker="node_distance"), "communities")
    labelled = filters.SearchFilters(node_labels=["Place"])
    assert g.search("red", recipe="edges_rrf", where=labelled)["edges"].count() == 0
    both = search.merged([g.search("red", recipe="edges_rrf"), g.search("other", recipe="edges_rrf")])
    assert {r.uuid for r in both["edges"].collect()} == {"e1", "e2", "e3"}
    twice = search.merged([g.search("red", recipe="edges_rrf")] * 2)
    assert sorted(r.uuid for r in twice["edges"].collect()) == ["e1", "e1", "e2", "e2"]
    g.build_indices()
    assert {r.uuid: round(r.score, 9) for r in g.search_text("edges", "red wine").collect()} == {r.uuid: round(r.score, 9) for r in search.bm25(g.table("edges"), "red wine", ["name", "fact"]).collect()}
    assert g.search_text("edges", " ").count() == 0


def test_service(g, spark, capsys):
    messages = spark.createDataFrame([("m1", "g", "user", "Ann", "hello"), ("m2", "g", "user", None, "bye")], "uuid string, group_id string, role_type string, role string, content string").withColumn("timestamp", stamp("2024-01-01"))
    service.add_messages(g, messages, lambda e: (people(spark, ENDS), facts(spark, [("e1", "a", "b", "LIKES", "Alice likes Bob", ["m1"])], "2024-01-01")), "2025-01-01")
    assert {r.uuid: r.content for r in g.table("episodes").collect()} == {"m1": "Ann(user): hello", "m2": "(user): bye"}
    asked = spark.createDataFrame([(1, "user", "Ann", "who likes Bob")], "ord int, role_type string, role string, content string")
    assert [r.uuid for r in service.memory(g, asked, "g").collect()] == ["e1"] and service.memory(g, asked, "other").count() == 0
    assert service.fact(g, "e1").columns == list(filters.FACT_COLUMNS) and service.last_episodes(g, "g", 1, "2024-02-01").count() == 1
    main([g.path, "stats"])
    main([g.path, "search", "likes", "--recipe", "edges_rrf"])
    assert "edges\te1\t" in capsys.readouterr().out
    service.save_entity(g, "n", "g", "New")
    assert g.table("entities").where("uuid = 'n'").first().labels == ["Entity"]
    service.delete_fact(g, "e1")
    service.delete_episode(g, "m1")
    assert g.table("edges").count() == 0 and g.table("episodes").count() == 1
    service.delete_group(g, "g")
    assert g.table("entities").count() == 0


def test_state_rewrites_touched_buckets_only(spark, tmp_path):
    state = TableState(spark, str(tmp_path / "s"), 8)
    rows = lambda r: spark.createDataFrame(r, "uuid string, name string")
    state.merge(rows([(str(i), "old") for i in range(50)]), 0)
    state.merge(rows([("7", "new")]), 1)
    assert len(list((tmp_path / "s" / "g-1").glob("bucket=*"))) == 1
    state.merge(rows([("7", "newer")]), 2)
    state.merge(rows([("7", "newer")]), 2)  # run again
    got = {r.uuid: r.name for r in state.read().collect()}
    assert len(got) == 50 and got["7"] == "newer" and got["8"] == "old"
    assert sum(1 for _ in (tmp_path / "s").glob("g-*/bucket=*")) == 8 + 1


def test_pairs_summaries_and_order(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    rows = spark.createDataFrame([(f"n{i:02d}", [float(x) for x in r]) for i, r in enumerate(v)], "uuid string, e array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = sorted((1 - float(u[i] @ u[j]), f"n{i:02d}", f"n{j:02d}") for i in range(60) for j in range(i + 1, 60))[:25]
    canon_block, canon.PAIR_BLOCK = canon.PAIR_BLOCK, 13
    try:
        got = canon.nearest_pairs(rows, "e", 25).collect()
    finally:
        canon.PAIR_BLOCK = canon_block
    assert [(r.a, r.b) for r in got] == [w[1:] for w in want]
    parts = spark.createDataFrame([("k", i, str(i)) for i in range(5)] + [("z", 0, "one")], "community string, ord int, summary string")
    assert {r.community: r.summary for r in canon.merged_summaries(parts, lambda c: F.concat(F.lit("("), c, F.lit(")"))).collect()} == {"k": "(((0 1) (2 3)) 4)", "z": "one"}
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "x", "y"), (4, "c", "d")], "ord int, a string, b string")
    assert {r.uuid: r.canonical for r in graph.follow_ordered(pairs, Lineage(spark)).collect()} == {"a": "d", "b": "d", "c": "d", "d": "d", "x": "y", "y": "y"}
    np.savez(tmp_path / "e.npz", names=np.array(["a", "b", "a"]), embeddings=np.arange(6.0).reshape(3, 2))
    assert {r.name: r.embedding for r in npz_embeddings(spark, str(tmp_path / "e.npz")).collect()} == {"a": [4.0, 5.0], "b": [2.0, 3.0]}
    names = spark.createDataFrame([("k", "A", 3), ("k", "b", 1)], "cluster_id string, name string, count int")
    pick = lambda reply: canon.picked_representatives(names, lambda c: F.lit(reply)).first().representative
    assert pick("B") == "b" and pick("none") == "A"


def test_outputs_by_threshold_and_chunk(spark, tmp_path):
    df = spark.createDataFrame([(0.1, "a"), (0.2, "b")], "threshold double, name string")
    store.write_thresholds(df, str(tmp_path / "t"))
    store.write_thresholds(df.where("threshold = 0.2").withColumn("name", F.lit("c")), str(tmp_path / "t"))
    assert {(r.threshold, r.name) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "t")).collect()} == {(0.1, "a"), (0.2, "c")}
    for chunk in (1, 2):
        store.export_generation(df, ["name"], str(tmp_path / "c"), chunk)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["chunk=1", "chunk=2"]
    assert report.error_bucket(F.lit("x")) is not None and filters.SPELLED[">="] == "gte"


def test_episodes_of_edges_and_ends(spark):
    edges = spark.createDataFrame([("1", "a", "b", ["x", "y"]), ("2", "b", "c", ["y"])], "uuid string, source_node_uuid string, target_node_uuid string, episodes array<string>")
    episodes = spark.createDataFrame([("x",), ("y",), ("z",)], "uuid string")
    assert sorted(r.uuid for r in graph.episodes_of(edges, episodes).collect()) == ["x", "y"]
    assert [r.uuid for r in filters.between(edges, "b").collect()] == ["2"] and filters.between(edges, "a", "c").count() == 0 and filters.between(edges).count() == 2
    assert filters.indexed(edges, spark.createDataFrame([("a",)], "idx string"), "source_node_uuid").count() == 1
