"""Ingestion by group and by what a judge says."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factgraph.operators import filters
from factgraph.plans.api import Judge, TemporalGraph


def stamp(c):
    return F.to_timestamp(F.lit(c))


@pytest.fixture()
def g(spark, tmp_path):
    return TemporalGraph(spark, str(tmp_path / "graph"), buckets=4)


def add(g, spark, episode, group, day, nodes, edges, **more):
    """nodes (uuid, name, label, attributes), edges (uuid, source, target, fact)"""
    eps = spark.createDataFrame([(episode, "ep", group, "text")], "uuid string, name string, group_id string, content string").withColumn("valid_at", stamp(day)).withColumn("created_at", stamp(day))
    n = spark.createDataFrame([(*x, *["Person", None][len(x) - 2 :]) for x in nodes], "uuid string, name string, label string, attributes string")
    n = n.withColumn("group_id", F.lit(group)).withColumn("labels", F.array("label")).withColumn("created_at", stamp(day)).withColumn("summary", F.lit(""))
    e = spark.createDataFrame([(*x, [episode]) for x in edges], "uuid string, source_node_uuid string, target_node_uuid string, fact string, episodes array<string>")
    e = e.withColumn("name", F.lit("R")).withColumn("group_id", F.lit(group)).withColumn("valid_at", stamp(day)).withColumn("created_at", stamp(day))
    return g.add_episodes(eps, lambda _: (n, e), "2025-01-01", **more)


NODES = [("a", "Alice Smith"), ("b", "Acme Corp")]


def test_groups_are_apart(g, spark):
    add(g, spark, "ep1", "g1", "2020-01-01", NODES, [("e1", "a", "b", "Alice works at Acme")])
    add(g, spark, "ep2", "g2", "2020-01-01", [("a2", "Alice Smith"), ("b2", "Acme Corp")], [("e2", "a2", "b2", "Alice works at Acme")])
    add(g, spark, "ep3", "g2", "2020-02-01", [("a3", "ALICE SMITH"), ("b3", "Acme Corp")], [("e3", "a3", "b3", "alice works at  acme")])
    assert {(r.uuid, r.group_id) for r in g.table("entities").collect()} == {("a", "g1"), ("b", "g1"), ("a2", "g2"), ("b2", "g2")}
    assert {(r.uuid, r.group_id): r.episodes for r in g.table("edges").collect()} == {("e1", "g1"): ["ep1"], ("e2", "g2"): ["ep2", "ep3"]}


def test_another_wording_ends_nothing_without_a_judge(g, spark):
    add(g, spark, "ep1", "g", "2020-01-01", NODES, [("e1", "a", "b", "Alice works at Acme")])
    add(g, spark, "ep2", "g", "2021-01-01", NODES, [("e2", "a", "b", "Alice owns shares of Acme")])
    assert all(r.invalid_at is None and r.expired_at is None for r in g.table("edges").collect())


def told(*pairs):
    def contradicts(asked):
        assert asked.columns == ["new_uuid", "new_fact", "new_valid_at", "uuid", "fact", "valid_at"]
        return asked.sparkSession.createDataFrame(list(pairs), "new_uuid string, uuid string")

    return Judge(contradicts=contradicts)


def test_what_a_judge_says_is_ended(g, spark):
    add(g, spark, "ep1", "g", "2020-01-01", [*NODES, ("c", "Carol")], [("e1", "a", "b", "Alice works at Acme"), ("e3", "a", "b", "Alice owns Acme"), ("e4", "c", "b", "Carol runs Acme")])
    add(g, spark, "ep2", "g", "2021-01-01", NODES, [("e2", "a", "b", "Alice left Acme")], judge=told(("e2", "e1"), ("e2", "e4"), ("e2", "unknown"), ("x", "e3")))
    rows = {r.uuid: r for r in g.table("edges").collect()}
    assert rows["e1"].invalid_at == rows["e4"].invalid_at == rows["e2"].valid_at and rows["e1"].expired_at is not None
    assert rows["e3"].invalid_at is None and rows["e2"].invalid_at is None
    add(g, spark, "ep0", "g", "2019-01-01", NODES, [("e0", "a", "b", "Alice plans to leave Acme")], judge=told(("e0", "e2")))
    late = next(r for r in g.table("edges").collect() if r.uuid == "e0")
    assert late.invalid_at == rows["e2"].valid_at and late.expired_at is not None


def test_a_judge_of_both_ends(g, spark):
    add(g, spark, "ep1", "g", "2020-01-01", [*NODES, ("c", "Carol")], [("e1", "b", "a", "Acme employs Alice"), ("e4", "c", "b", "Carol runs Acme")])
    add(g, spark, "ep2", "g", "2021-01-01", NODES, [("e2", "a", "b", "Alice left Acme")], judge=replace(told(("e2", "e1"), ("e2", "e4")), both_ends=True))
    assert {r.uuid: r.invalid_at is None for r in g.table("edges").collect()} == {"e1": False, "e2": True, "e4": True}


def test_facts_of_other_groups_are_no_candidates(g, spark):
    add(g, spark, "ep1", "g1", "2020-01-01", NODES, [("e1", "a", "b", "Alice works at Acme")])
    add(g, spark, "ep2", "g2", "2021-01-01", [("a2", "Alice Smith"), ("b2", "Acme Corp")], [("e2", "a2", "b2", "Alice left Acme")], judge=told(("e2", "e1")))
    assert all(r.invalid_at is None for r in g.table("edges").collect())


def test_replies_resolve_what_rules_cannot(g, spark):
    add(g, spark, "ep1", "g", "2020-01-01", [*NODES, ("c", "Carol Jones")], [("e1", "a", "b", "Alice works at Acme")])
    add(g, spark, "epx", "other", "2020-01-01", [("z", "Smith Alice Maria")], [])
    asked = []

    def same(questions):
        rows = questions.collect()
        asked.extend(rows)
        at = {r.id: next((c.idx for c in r.candidates if c.uuid == "a"), 99) for r in rows}
        replies = [(0, "n1", at["n1"]), (1, "n1", 99), (2, "unknown", 0), (3, "n2", 99)]
        return questions.sparkSession.createDataFrame(replies, "ord int, id string, duplicate_idx int")

    got = add(g, spark, "ep2", "g", "2021-01-01", [("n1", "Dr. Smith, Alice M."), ("n2", "Acme Holding"), ("n3", "Nobody Known")], [("e2", "n1", "n2", "Alice Smith sold it")], judge=Judge(same=same))
    assert {r.id: {c.uuid for c in r.candidates} for r in asked} == {"n1": {"a"}, "n2": {"b"}}
    assert {r.uuid for r in g.table("entities").where("group_id = 'g'").collect()} == {"a", "b", "c", "n2", "n3"}
    assert next(r for r in g.table("edges").collect() if r.uuid == "e2").source_node_uuid == "a"
    assert {(r.source_node_uuid, r.target_node_uuid) for r in got.duplicates.collect()} == {("n1", "a")}


def test_institutions_by_their_ids(g, spark):
    index = spark.createDataFrame([("Acme Corp", "r1"), ("Beta Lab", "r2")], "name string, ror_id string")
    inst = lambda u, n, a=None: (u, n, "Institution", a)
    add(g, spark, "ep1", "g", "2020-01-01", [inst("b", "Acme Corp"), inst("l", "Gamma", '{"institution_name": "gamma one"}')], [], institutions=index)
    add(g, spark, "ep2", "g", "2021-01-01", [inst("b2", "acme corp"), inst("l2", "Gamma", '{"institution_name": "gamma two"}')], [], institutions=index)
    assert {r.uuid for r in g.table("entities").collect()} == {"b", "l", "l2"}


def test_dates_first_seen_and_marks(g, spark):
    dates = lambda facts: facts.sparkSession.createDataFrame([("e1", "2018-05-01T00:00:00Z", "2019-05-01T00:00:00Z")], "uuid string, valid_at string, invalid_at string")
    nodes = spark.createDataFrame([("n9", "Alice Smith", 0), ("n1", "alice smith", 1), ("b", "Acme Corp", 2)], "uuid string, name string, ord int").withColumn("group_id", F.lit("g")).withColumn("labels", F.array(F.lit("Person"))).withColumn("created_at", stamp("2020-01-01"))
    edge = spark.createDataFrame([("e1", "n1", "b", "Alice works at Acme", ["ep1"], "g")], "uuid string, source_node_uuid string, target_node_uuid string, fact string, episodes array<string>, group_id string").withColumn("created_at", stamp("2020-01-01"))
    eps = spark.createDataFrame([("ep1", "ep", "g")], "uuid string, name string, group_id string").withColumn("created_at", stamp("2020-01-01"))
    g.add_episodes(eps, lambda _: (nodes, edge), "2025-01-01", judge=Judge(dates=dates), mark=("s", 0))
    row = g.table("edges").first()
    assert (row.source_node_uuid, str(row.valid_at)[:4], str(row.invalid_at)[:4]) == ("n9", "2018", "2019") and row.expired_at is not None
    before = g.versions.versions()
    assert g.add_episodes(eps, lambda _: (nodes, edge), "2025-01-01", mark=("s", 0)) is None and g.versions.versions() == before


def test_excluded_types_and_their_facts_stay_out(g, spark):
    nodes = [("a", "Alice Smith", "Person"), ("b", "Acme Corp", "Company"), ("c", "Berlin", "Entity")]
    facts = [("e1", "a", "b", "Alice works at Acme"), ("e2", "a", "c", "Alice lives in Berlin"), ("e3", "b", "c", "Acme is in Berlin")]
    add(g, spark, "ep1", "g", "2020-01-01", nodes, facts, excluded_types=["Company"])
    assert {r.uuid for r in g.table("entities").collect()} == {"a", "c"} and {r.uuid for r in g.table("edges").collect()} == {"e2"}
    rows, none = (spark.createDataFrame([(u, x) for u, x in d], "uuid string, labels array<string>") for d in ([("p", ["Entity"]), ("q", None), ("r", ["Entity", "Person"])], []))
    ends = spark.createDataFrame([("e", "p", "r"), ("f", "r", "r")], "uuid string, source_node_uuid string, target_node_uuid string")
    kept, left = filters.without_excluded(rows, ends, ["Entity"])
    assert [r.uuid for r in kept.collect()] == ["r"] and [r.uuid for r in left.collect()] == ["f"]
    assert filters.without_excluded(none, ends, ["Entity"])[1].count() == 2


def test_attributes_lose_what_columns_say(g, spark):
    add(g, spark, "ep1", "g", "2020-01-01", [("a", "Alice Smith", "Person", '{"age":7,"uuid":"x","Name_Embedding":[1],"of":{"name":"y"}}'), ("b", "Bob Jones", "Person", "no object")], [])
    assert {r.uuid: r.attributes for r in g.table("entities").collect()} == {"a": '{"age":7,"of":{"name":"y"}}', "b": "no object"}
