"""Operators on small graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph import sources, streaming
from factgraph.operators import canon, graph, report, resolve, search, store, temporal
from factgraph.plans.lineage import Lineage


def edges(spark, rows):
    return spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, group_id string")


def test_bfs_levels(spark):
    e = edges(spark, [("1", "a", "b", "g"), ("2", "b", "c", "g"), ("3", "c", "d", "g"), ("4", "c", "a", "g"), ("5", "x", "y", "g")])
    start = spark.createDataFrame([("a",)], "uuid string")
    got = {r.uuid: r.hop for r in graph.edges_within(e, start, 3, Lineage(spark)).collect()}
    assert got == {"1": 1, "2": 2, "3": 3, "4": 3}
    assert {r.uuid for r in graph.nodes_within(e, start, 2, Lineage(spark)).collect()} == {"b", "c"}


def test_components_and_pointers(spark):
    pairs = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "a string, b string")
    assert {r.uuid: r.canonical for r in graph.components(pairs, Lineage(spark)).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "uuid string, canonical string")
    assert {r.uuid: r.canonical for r in graph.follow(chain, Lineage(spark)).collect()} == {"a": "c", "b": "c"}
    moved = graph.repoint(edges(spark, [("1", "alias", "t", "g")]), spark.createDataFrame([("alias", "canon")], "uuid string, canonical string"))
    assert moved.select("source_node_uuid", "target_node_uuid").first() == ("canon", "t")


def test_label_propagation_ends_on_a_swapping_pair(spark):
    links = spark.createDataFrame([("a", "b", 2), ("b", "a", 2)], "uuid string, neighbour string, weight long")
    got = {r.uuid: r.community for r in graph.label_propagation(links, Lineage(spark)).collect()}
    assert got["a"] == got["b"] == "a"


def test_rrf_keeps_first_seen_on_ties(spark):
    lists = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("b", 1, 0), ("c", 1, 1)], "uuid string, method int, rank int")
    got = [(r.uuid, r.score) for r in search.rrf(lists).orderBy(F.desc("score"), "seen").collect()]
    assert got == [("b", 1.5), ("a", 1.0), ("c", 0.5)]


def test_rerankers(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "uuid string, embedding array<double>")
    got = {r.uuid: round(r.score, 6) for r in search.mmr(rows, [1.0, 0.0]).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 0.0}
    near = search.node_distance(rows, edges(spark, [("1", "a", "b", "g")]), "a")
    assert {r.uuid: r.score for r in near.collect()} == {"a": 10.0, "b": 1.0, "c": 0.0}
    m = spark.createDataFrame([("e1", "a"), ("e2", "a")], "source_node_uuid string, target_node_uuid string")
    assert {r.uuid: r.mentions for r in search.by_mentions(rows, m).collect()} == {"a": 2.0, "b": float("inf"), "c": float("inf")}
    assert len(search.RECIPES) == 16


def test_blank_query_finds_nothing(spark):
    rows = spark.createDataFrame([("a", "red widget")], "uuid string, name string")
    assert search.bm25(rows, "  ", ["name"]).count() == 0 and search.bm25(rows, "Red", ["name"]).count() == 1


@pytest.mark.parametrize(
    ("e_valid", "e_invalid", "n_valid", "n_invalid", "want"),
    [
        ("2020-01-01", None, "2021-01-01", None, True),
        ("2021-01-01", None, "2021-01-01", None, False),
        ("2022-01-01", None, "2021-01-01", None, False),
        (None, None, "2021-01-01", None, False),
        ("2020-01-01", "2021-01-01", "2021-01-01", None, False),
        ("2020-01-01", "2022-01-01", "2021-01-01", None, True),
        ("2020-01-01", None, "2021-01-01", "2020-01-01", False),
    ],
)
def test_contradiction_table(spark, e_valid, e_invalid, n_valid, n_invalid, want):
    df = spark.createDataFrame([(e_valid, e_invalid, n_valid, n_invalid)], "ev string, ei string, nv string, ni string")
    df = df.select(*(F.to_timestamp(a).alias(b) for a, b in (("ev", "e_valid_at"), ("ei", "e_invalid_at"), ("nv", "n_valid_at"), ("ni", "n_invalid_at"))), F.lit(None).cast("timestamp").alias("e_expired_at"))
    row = temporal.contradicted(df, "2030-01-01").first()
    assert row["invalidated"] is want and (row["new_invalid_at"] == (row["n_valid_at"] if want else row["e_invalid_at"]))
    assert (row["new_expired_at"] is not None) is want


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "uuid string, name string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "uuid string, name string")
    assert {(r.uuid, r.name) for r in store.upsert(old, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    nodes, rest = store.delete_nodes(old, edges(spark, [("1", "a", "b", "g"), ("2", "b", "b", "g")]), spark.createDataFrame([("a",), ("zz",)], "uuid string"))
    assert nodes.count() == 1 and [r.uuid for r in rest.collect()] == ["2"]


def test_average_linkage_matches_its_definition():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.normal(size=(7, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        d = 1 - v @ v.T
        parts = [[i] for i in range(7)]
        while len(parts) > 1:
            pairs = [(d[np.ix_(parts[i], parts[j])].mean(), i, j) for i in range(len(parts)) for j in range(i)]
            low, i, j = min(pairs)
            if low >= 0.7:
                break
            parts[j] += parts[i]
            del parts[i]
        labels = canon.average_linkage(d, 0.7)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())} == {frozenset(p) for p in parts}


def test_backmap_modes(spark):
    raw = spark.createDataFrame([("IS_GROWN", 3), ("GROWN", 2), ("EATEN", 1)], "name string, count long")
    mapping = spark.createDataFrame([(0, "IS_GROWN", "EATEN"), (0, "EATEN", "EATEN")], "cluster_id int, name string, representative string")
    assert {(r.name, r["count"]) for r in canon.backmap(raw, mapping).collect()} == {("IS_GROWN", 3), ("GROWN", 2), ("EATEN", 1)}
    assert {(r.name, r["count"]) for r in canon.backmap(raw, mapping, legacy=True).collect()} == {("EATEN", 1)}


def test_resolution(spark):
    ours = spark.createDataFrame([("x1", "red widgets"), ("x2", "completely unknown thing"), ("x3", "large blue anvil maker")], "uuid string, name string")
    known = spark.createDataFrame([("p2", "Red Widget"), ("p1", "red  widget"), ("p3", "large blue anvil makers!")], "uuid string, name string")
    got = {r.uuid: (r.canonical, r.reason) for r in resolve.resolve(ours, known).collect()}
    assert got["x1"] == ("p1", "exact") and "x2" not in got and got["x3"][0] == "p3"


def test_fact_duplicates_use_each_edge_once(spark):
    rows = [(f"e{i}", "a", "b", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.01], [1.0, 0.02], [0.0, 1.0]])]
    df = spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, v array<double>")
    got = resolve.fact_duplicates(df, "v").collect()
    assert len(got) == 1 and "e3" not in got[0]


def test_reports(spark):
    sizes = spark.createDataFrame([(1, 4, 1), (2, 4, 3)], "cluster_id int, total_count long, members long")
    assert report.entropy(sizes).first() == (1.0, 1.0)
    assert report.entropy(sizes.limit(1)).first() == (0.0, 0.0)
    assert [r.cdf for r in report.cdf(sizes, "members").orderBy("value").collect()] == [0.5, 1.0]


def test_sources(spark, tmp_path):
    (tmp_path / "2_b.txt").write_text("zwei", "utf-8")
    (tmp_path / "10_a.txt").write_bytes("zé".encode("latin-1"))
    (tmp_path / "other.txt").write_text("no")
    rows = sources.numbered_texts(spark, str(tmp_path))
    assert [(r.number, r.text) for r in rows.collect()] == [(2, "zwei"), (10, "zé")]
    assert sources.merged_text(rows).first()["text"] == "zwei\nzé"
    (tmp_path / "e.csv").write_text("Unnamed: 0,name\n0,X\n")
    assert [tuple(r) for r in sources.separated(spark, str(tmp_path / "e.csv")).collect()] == [("X",)]
    assert sources.parse_thresholds(None)[:2] == [0.1, 0.2] and sources.parse_thresholds("0.2", True) == [0.8]
    assert sources.cluster_file(["collapsed_sim_0.3.csv", "merged_sim_0.30.csv"], 0.3) == "merged_sim_0.30.csv"


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ty\n", ["L"])], "uuid string, name string, labels array<string>")
    store.export_tsv(df, ["uuid", "name", "labels"], str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert (tmp_path / "out" / "_header.tsv").read_text() == "uuid\tname\tlabels\n"
    assert [line.split("\t") for line in lines] == [["a", "x\\ty\\n", '["L"]']]
    store.export_tsv(df.limit(0), ["uuid", "name"], str(tmp_path / "none"))
    assert (tmp_path / "none" / "_header.tsv").read_text() == "uuid\tname\n"
    assert not any(p.read_text() for p in (tmp_path / "none").iterdir() if p.name.startswith("part-"))


def test_stream_merges_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "uuid string, name string, created_at timestamp"
    rows = spark.createDataFrame([("a", "old", "2024-01-01"), ("a", "new", "2024-01-02"), ("b", "x", "2024-01-01")], "uuid string, name string, t string").select("uuid", "name", F.to_timestamp("t").alias("created_at"))
    state = streaming.TableState(spark, str(tmp_path / "state"))
    rows.write.parquet(str(source))
    streaming.ingest(spark.readStream.schema(schema).parquet(str(source)), state, str(tmp_path / "ck")).awaitTermination()
    rows.where("uuid = 'b'").withColumn("name", F.lit("y")).write.mode("append").parquet(str(source))
    streaming.ingest(spark.readStream.schema(schema).parquet(str(source)), state, str(tmp_path / "ck")).awaitTermination()
    assert {(r.uuid, r.name) for r in state.read().collect()} == {("a", "new"), ("b", "y")}
