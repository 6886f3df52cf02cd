"""Traversal by group, places of a distribution, files, graphs of a folder, schemas of replies."""

import json

from factgraph import sources
from factgraph.functions import schemas
from factgraph.operators import graph, report, search
from factgraph.plans.api import TemporalGraph, graphs
from factgraph.plans.lineage import Lineage


def test_nodes_of_the_origins_group(spark):
    links = spark.createDataFrame([("e", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source_node_uuid string, target_node_uuid string")
    nodes = spark.createDataFrame([("a", "g"), ("b", "h"), ("c", "g"), ("d", None)], "uuid string, group_id string")

    def reached(rows, depth):
        origins = spark.createDataFrame(rows, "uuid string, group_id string")
        return {(r.uuid, r.hop) for r in graph.nodes_of_group_within(links, origins, nodes, depth, Lineage(spark)).collect()}

    assert reached([("e", "g")], 1) == {("a", 1)}
    assert reached([("e", "g")], 3) == {("a", 1), ("c", 3)}  # b lies between and is of another group
    assert reached([("a", "g")], 3) == {("c", 2), ("a", 3)}  # on a circle
    assert reached([("e", "g"), ("e", "h")], 2) == {("a", 1), ("b", 2)}
    assert reached([("a", "g")], 0) == set() and reached([], 2) == set() and reached([("c", None)], 2) == set()


def test_traversal_goes_from_episodes_by_mentions(spark):
    nodes = spark.createDataFrame([("a", "g", "x"), ("b", "g", "y"), ("c", "h", "z")], "uuid string, group_id string, name string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c")], "uuid string, source_node_uuid string, target_node_uuid string")
    mentions = spark.createDataFrame([("m", "e", "a")], "uuid string, source_node_uuid string, target_node_uuid string")
    around = search.Surroundings(edges, mentions, None, spark.createDataFrame([("e",)], "uuid string"), spark.createDataFrame([("e", "g")], "uuid string, group_id string"))
    found = search.hybrid(nodes, "nothing", None, ["name"], None, search.Recipe(("bfs",)), "nodes", around)
    assert [r.uuid for r in found.collect()] == ["a", "b"]
    found = search.hybrid(edges, "nothing", None, ["uuid"], None, search.Recipe(("bfs",)), "edges", around)
    assert {r.uuid for r in found.collect()} == {"1", "2"}


def test_places_of_every_row(spark):
    rows = spark.createDataFrame([(x,) for x in [3, 1, 2, 2, 2, None, 7]], "c int")
    found = sorted((r.value, round(r.cdf, 6)) for r in report.cdf_rows(rows, "c", Lineage(spark)).collect())
    assert found == [(v, round((i + 1) / 6, 6)) for i, v in enumerate([1, 2, 2, 2, 3, 7])]
    hot = spark.range(3000).selectExpr("if(id < 2500, 5L, id) as c")
    found = sorted((r.value, r.cdf) for r in report.cdf_rows(hot, "c", Lineage(spark)).collect())
    assert [v for v, _ in found] == sorted([5] * 2500 + list(range(2500, 3000))) and [round(p * 3000) for _, p in found] == list(range(1, 3001))
    assert report.cdf_rows(rows.limit(0), "c", Lineage(spark)).collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("uuid\tat\tnote\na\t2024-01-02 03:04:05\t\nb\tsoon\tx\n")
    rows = {r.uuid: r for r in sources.separated(spark, str(tmp_path / "t.tsv"), times=["at"]).collect()}
    assert str(rows["a"].at) == "2024-01-02 03:04:05" and rows["a"].note is None and rows["b"].at is None and rows["b"].note == "x"
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "print-config.json").write_text(json.dumps({"text_splitter": {"chunk_size": 900, "chunk_overlap": 90}}))
    (tmp_path / "c2").mkdir()
    (tmp_path / "c2" / "print-config.json").write_text("{no json")
    found = {r.path.split("/")[-2]: (r.chunk_size, r.chunk_overlap) for r in sources.run_configuration(spark, f"{tmp_path}/*/print-config.json").collect()}
    assert found == {"c1": (900, 90), "c2": (None, None)}
    sources.write_merged(spark.createDataFrame([(2, "two\nlines"), (10, "ten"), (1, "one")], "number int, text string"), str(tmp_path / "corpus"))
    parts = sorted(p for p in (tmp_path / "corpus").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts) == "one\ntwo\nlines\nten\n"


def test_graphs_of_a_folder(spark, tmp_path):
    assert graphs(spark, str(tmp_path / "none")) == []
    (tmp_path / "other").mkdir()
    for name in ("b", "a"):
        made = TemporalGraph(spark, str(tmp_path / name))
        made.upsert("entities", spark.createDataFrame([("n", "x", "g1"), ("m", "y", "g2")], "uuid string, name string, group_id string").selectExpr("*", "array('L') as labels"))
    assert graphs(spark, str(tmp_path)) == ["a", "b"]
    made.export(str(tmp_path / "out"), "a", ["g2"])
    lines = [line for p in (tmp_path / "out" / "nodes_a").iterdir() if p.suffix == ".csv" for line in p.read_text().splitlines()]
    assert [line.split("\t")[0] for line in lines] == ["m"]
    assert made.drop() and graphs(spark, str(tmp_path)) == ["b"] and not made.drop()


def test_schemas_of_replies():
    schema = {
        "$defs": {"Item": {"type": "object", "properties": {"next": {"$ref": "#/$defs/Item"}, "kind": {"$ref": "#/$defs/Kind"}}}, "Kind": {"type": "string"}},
        "type": "object", "additionalProperties": False, "properties": {"items": {"type": "array", "items": {"$ref": "#/$defs/Item"}}, "far": {"$ref": "elsewhere"}},
    }
    flat = schemas.simplified(schema)
    assert set(flat) == {"type", "properties", "required"} and flat["required"] == ["items", "far"]
    assert flat["properties"]["items"]["items"]["properties"] == {"next": {"$ref": "#/$defs/Item"}, "kind": {"type": "string"}}
    assert flat["properties"]["far"] == {"$ref": "elsewhere"}
    assert schemas.simplified({"type": "object", "properties": {"a": {}}, "required": []})["required"] == []
    assert json.dumps(schemas.canonical({"b": [{"d": 1, "c": 2}, 0], "a": None})) == '{"a": null, "b": [{"c": 2, "d": 1}, 0]}'
