"""One query for each operator, on the bound test tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.functions import vectors as V
from factgraph.operators import canon, chunking, filters, graph, report, resolve, search, store, temporal
from factgraph.operators.embed import EmbeddingCache
from factgraph.plans.api import Judge, TemporalGraph
from factgraph.plans.bind import Bound
from factgraph.plans.index import TextIndex
from factgraph.plans.lineage import Lineage
from factgraph.plans.versions import Versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The bound tables in the checking dialect.
GRAPH = r"""
WITH RECURSIVE ent AS (
  SELECT 'c' || c_custkey AS uuid, c_name AS name, ['Entity', 'Customer'] AS labels, 'g' || (c_nationkey % 3) AS group_id, c_mktsegment AS summary FROM customer
  UNION ALL SELECT 'p' || p_partkey, p_name, ['Entity', 'Part'], 'g0', p_type FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, ['Entity', 'Supplier'], 'g' || (s_nationkey % 3), 'supplier' FROM supplier),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_shipdate) AS l_shipdate, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL),
edge AS (SELECT 'e' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS uuid, 'c' || o_custkey AS s, 'p' || l_partkey AS t, 'ORDERED_' || l_returnflag AS name,
  'g' || (o_custkey % 3) AS group_id, o_orderdate AS valid_at, l_shipdate AS created_at, 'o' || l_orderkey AS ep FROM li JOIN orders ON l_orderkey = o_orderkey),
ended AS (SELECT *, lead(valid_at) OVER (PARTITION BY s, t ORDER BY valid_at, uuid) AS invalid_at FROM edge),
fact AS (SELECT edge.*, c_name || ' ordered ' || p_name AS fact FROM edge JOIN customer ON s = 'c' || c_custkey JOIN part ON t = 'p' || p_partkey),
vedge AS (SELECT 'f' || vec_id AS uuid, 'c' || (vec_id % 50) AS s, 'p' || label AS t, 'g' || (label % 3) AS group_id, 'fact ' || (vec_id % 7) || ' about ' || label AS fact, CAST(embedding AS DOUBLE[]) AS v, vec_id % 3 + 1 AS neps FROM embeddings),
vnode AS (SELECT 'c' || vec_id AS uuid, CAST(embedding AS DOUBLE[]) AS v, label, ent.name, ent.group_id, summary FROM embeddings JOIN ent ON ent.uuid = 'c' || vec_id),
q0 AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
episode AS (SELECT 'v' || event_id AS uuid, 'u' || user_id AS group_id, event_type AS source, ts AS valid_at, props AS content FROM events),
msg AS (SELECT 'm' || conv_id || '_' || turn AS uuid, 'k' || conv_id AS group_id, text AS content, role AS source, turn FROM conversations),
ment AS (SELECT DISTINCT 'o' || l_orderkey AS s, 'p' || l_partkey AS t FROM lineitem),
comm AS (SELECT DISTINCT 'k' || replace(p_brand, 'Brand#', '') AS uuid, 'brand ' || replace(p_brand, 'Brand#', '') AS name FROM part),
memb AS (SELECT 'k' || replace(p_brand, 'Brand#', '') AS s, 'p' || p_partkey AS t FROM part),
nc AS (SELECT (CASE WHEN p_partkey % 2 = 0 THEN 'IS_' ELSE '' END) || upper(replace(p_name, ' ', '_')) AS name, count(*) AS n FROM part GROUP BY 1),
ncn AS (SELECT *, CASE WHEN lower(replace(name, '_', ' ')) LIKE 'is %' THEN substr(lower(replace(name, '_', ' ')), 4) ELSE lower(replace(name, '_', ' ')) END AS norm FROM nc),
mp AS (SELECT split_part(replace(name, 'IS_', ''), '_', 1) AS cluster_id, name, n FROM nc),
mprep AS (SELECT cluster_id, name AS representative FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(name), name) AS r FROM mp) WHERE r = 1),
sizes AS (SELECT cluster_id, sum(n) AS total_count, count(*) AS members FROM mp GROUP BY 1)
"""


def query(name: str, sql: str | None = None, bare: bool = False) -> Callable[[Callable[[Bound], DataFrame]], None]:
    def add(make: Callable[[Bound], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: make(Bound(spark, sf_dir))
        if sql:
            ORACLES[name] = sql if bare else GRAPH + sql

    return add


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- sinks and mutations ----------------------------------------------------------------------------------------

query(
    "upsert_entities",
    """SELECT uuid, CASE WHEN uuid LIKE 'c%0' THEN upper(name) ELSE name END AS name, group_id, array_to_string(labels, ',') AS labels FROM ent
       UNION ALL SELECT 'x' || n_nationkey, n_name, 'g9', 'Nation,Entity' FROM nation""",
)(
    lambda b: store.upsert(
        b.entities().select("uuid", "name", "group_id", "labels"),
        store.with_label(
            b.entities().where(F.col("uuid").rlike("^c.*0$")).select("uuid", F.upper("name").alias("name"), "group_id", "labels").unionByName(
                b.table("nation").select(F.concat(F.lit("x"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.lit("g9").alias("group_id"), F.array(F.lit("Nation")).alias("labels"))
            )
        ),
    ).withColumn("labels", joined("labels"))
)
query("delete_detach", "SELECT uuid FROM edge WHERE s NOT LIKE 'c%5' AND t NOT LIKE 'p%5'")(
    lambda b: store.delete_nodes(b.entities(), b.edges(), b.entities().where(F.col("uuid").rlike("^[cp].*5$")))[1].select("uuid")
)
query(
    "remove_episode",
    """, gone AS (SELECT 'o' || o_orderkey AS e FROM orders WHERE o_orderkey % 7 = 0)
       SELECT 'edge' AS kind, uuid FROM edge WHERE ep IN (SELECT e FROM gone)
       UNION ALL SELECT 'node', t FROM (SELECT t, count(DISTINCT s) AS n, min(s) AS e FROM ment GROUP BY t) WHERE n = 1 AND e IN (SELECT e FROM gone)
       UNION ALL SELECT 'episode', e FROM gone""",
)(lambda b: store.removed_with_episode(b.edges(), b.mentions(), b.order_episodes().where("cast(substr(uuid, 2) as long) % 7 = 0")))
def exported(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(uuid, line): an export of rows, written and read back as lines."""
    folder = f"{Lineage(rows.sparkSession).path}/export"
    store.export_tsv(rows, columns, folder)
    return rows.sparkSession.read.text(folder).select(F.substring_index("value", "\t", 1).alias("uuid"), F.col("value").alias("line"))


query("export_nodes_tsv", r"""SELECT uuid, uuid || chr(9) || 'Entity' || chr(9) || name || chr(9) || group_id || chr(9) || to_json(labels)::VARCHAR || chr(9) || summary AS line FROM ent""")(
    lambda b: exported(b.entities().withColumn("type", F.lit("Entity")), ["uuid", "type", "name", "group_id", "labels", "summary"])
)
query("export_edges_tsv", r"""SELECT uuid, uuid || chr(9) || 'RELATES_TO' || chr(9) || s || chr(9) || t || chr(9) || group_id || chr(9) || strftime(created_at, '%Y-%m-%d') || chr(9) || name || chr(9) || fact || chr(9) || '["' || ep || '"]' AS line FROM fact""")(
    lambda b: exported(
        b.facts().withColumn("type", F.lit("RELATES_TO")).withColumn("created_at", day("created_at")),
        ["uuid", "type", "source_node_uuid", "target_node_uuid", "group_id", "created_at", "name", "fact", "episodes"],
    )
)
query(
    "dedupe_audit",
    """, a AS (SELECT 'p' || p_partkey AS uuid, 'p' || min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical, p_name AS name, p_type || chr(10) || p_brand AS content FROM part)
       SELECT uuid AS alias_uuid, canonical AS canonical_uuid, name AS alias_name, replace(substr(content, 1, 200), chr(10), ' ') AS excerpt FROM a
       WHERE canonical IN (SELECT canonical FROM a GROUP BY 1 HAVING count(*) > 1)""",
)(
    lambda b: store.audit(
        b.table("part").join(b.table("part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("m")), ["p_name", "p_brand"]).select(
            F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.concat(F.lit("p"), "m").alias("canonical"), F.col("p_name").alias("name"), F.concat_ws("\n", "p_type", "p_brand").alias("content")
        )
    )
)
query("graph_statistics", "SELECT type, count(*) AS n FROM (SELECT name AS type FROM edge UNION ALL SELECT labels[2] FROM ent) GROUP BY 1")(
    lambda b: b.edges().select(F.col("name").alias("type")).unionByName(b.entities().select(F.element_at("labels", 2).alias("type"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
)

# ---- filters ----------------------------------------------------------------------------------------------------

query(
    "filter_date_dnf",
    "SELECT uuid FROM ended WHERE ((valid_at >= TIMESTAMP '1997-01-01' AND valid_at < TIMESTAMP '1997-07-01') OR (valid_at > TIMESTAMP '1999-01-01')) AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1999-06-01')",
)(
    lambda b: filters.SearchFilters(
        dates={"valid_at": [[(">=", "1997-01-01"), ("<", "1997-07-01")], [(">", "1999-01-01")]], "invalid_at": [[("IS NULL", None)], [(">", "1999-06-01")]]}
    ).apply(b.ended_edges()).select("uuid")
)
query("filter_edge_types", "SELECT uuid, name FROM edge WHERE name IN ('ORDERED_A', 'ORDERED_R') AND group_id IN ('g1')")(
    lambda b: filters.SearchFilters(edge_types=["ORDERED_A", "ORDERED_R"], group_ids=["g1"]).apply(b.edges()).select("uuid", "name")
)
query("filter_labels_any", "SELECT uuid FROM ent WHERE list_has_any(labels, ['Part', 'Supplier'])")(lambda b: filters.SearchFilters(node_labels=["Part", "Supplier"]).apply(b.entities()).select("uuid"))
query("filter_labels_all", "SELECT uuid FROM ent WHERE list_has_all(labels, ['Part', 'Entity'])")(lambda b: b.entities().where(filters.labels_all(F.col("labels"), ["Part", "Entity"])).select("uuid"))
query("filter_properties", "SELECT uuid FROM episode WHERE CAST(json_extract_string(content, '$.k') AS DOUBLE) > 50")(
    lambda b: b.episodes().where(filters.attribute(F.col("content"), "k", ">", 50)).select("uuid")
)
query("page_by_uuid", "SELECT uuid, name FROM ent WHERE uuid < 'p5' ORDER BY uuid DESC LIMIT 100")(lambda b: filters.page(b.entities().select("uuid", "name"), 100, "p5"))
query(
    "facts_context",
    "SELECT uuid, to_json({'fact': s || ' ' || t, 'valid_at': strftime(valid_at, '%Y-%m-%d'), 'invalid_at': coalesce(strftime(invalid_at, '%Y-%m-%d'), 'Present')})::VARCHAR AS context FROM ended",
)(lambda b: b.ended_edges().select("uuid", filters.context(F.concat_ws(" ", "source_node_uuid", "target_node_uuid")).alias("context")))
query("filter_endpoints", "SELECT uuid FROM edge WHERE s = 'c1' UNION ALL SELECT uuid FROM edge WHERE s = 'c2' AND t IN (SELECT min(t) FROM edge WHERE s = 'c2')")(
    lambda b: filters.between(b.edges(), "c1").select("uuid").unionByName(filters.between(b.edges(), "c2", b.edges().where("source_node_uuid = 'c2'").agg(F.min("target_node_uuid")).first()[0] or "").select("uuid"))
)
query("edges_labelled_ends", "SELECT edge.uuid FROM edge JOIN ent a ON s = a.uuid JOIN ent b ON t = b.uuid WHERE a.name LIKE '%1' AND b.name LIKE 'red%'")(
    lambda b: filters.labelled_ends(b.edges(), b.entities().withColumn("labels", F.when(F.col("name").rlike("1$|^red"), F.array(F.lit("Marked"))).otherwise(F.array(F.lit("Plain")))).where("uuid not like 'c%' or name like '%1'"), ["Marked"]).select("uuid")
)
KINDS = """, k AS (SELECT uuid, CASE WHEN length(uuid) % 3 = 0 THEN ' Episodic ' WHEN length(uuid) % 3 = 1 THEN 'RELATES_TO' END AS type FROM edge)"""


def kinds(b: Bound) -> DataFrame:
    n = F.length("uuid") % 3
    return b.edges().select("uuid", F.when(n == 0, " Episodic ").when(n == 1, "RELATES_TO").alias("type"))


query("relates_to_only", KINDS + " SELECT uuid FROM k WHERE type = 'RELATES_TO'")(lambda b: filters.of_type(kinds(b)).select("uuid"))
query("not_episodic", KINDS + " SELECT uuid FROM k WHERE type IS NULL OR lower(trim(type)) <> 'episodic'")(lambda b: filters.not_episodic(kinds(b)).select("uuid"))
query("fact_results", "SELECT fact.uuid, name, fact, strftime(valid_at, '%Y-%m-%d') AS valid_at, strftime(created_at, '%Y-%m-%d') AS created_at, CAST(NULL AS VARCHAR) AS expired_at FROM fact")(
    lambda b: filters.fact_results(b.facts()).select("uuid", "name", "fact", day("valid_at").alias("valid_at"), day("created_at").alias("created_at"), F.col("expired_at").cast("string").alias("expired_at"))
)
query("episodes_of_edges", "SELECT DISTINCT ep AS uuid FROM edge WHERE name = 'ORDERED_R'")(lambda b: graph.episodes_of(b.edges().where("name = 'ORDERED_R'"), b.order_episodes()).select("uuid"))
# ---- joins ------------------------------------------------------------------------------------------------------

query("edges_with_names", "SELECT edge.uuid, a.name AS source_name, b.name AS target_name FROM edge LEFT JOIN ent a ON s = a.uuid LEFT JOIN ent b ON t = b.uuid")(
    lambda b: graph.with_endpoint_names(b.edges(), b.entities()).select("uuid", "source_name", "target_name")
)
query("mentioned_nodes", "SELECT uuid, name FROM ent WHERE uuid IN (SELECT t FROM ment JOIN orders ON s = 'o' || o_orderkey WHERE o_orderstatus = 'P')")(
    lambda b: graph.mentioned_nodes(b.entities(), b.mentions(), b.order_episodes().where("source = 'P'")).select("uuid", "name")
)
query("communities_by_nodes", "SELECT uuid, name FROM comm WHERE uuid IN (SELECT s FROM memb JOIN ent ON t = ent.uuid WHERE name LIKE 'red%')")(
    lambda b: graph.communities_of(b.communities(), b.members(), b.entities().where("name like 'red%'")).select("uuid", "name")
)
query("relevant_edges", "SELECT a.uuid AS query_uuid, b.uuid FROM edge a JOIN edge b ON least(a.s, a.t) = least(b.s, b.t) AND greatest(a.s, a.t) = greatest(b.s, b.t) AND a.group_id = b.group_id AND a.uuid <> b.uuid")(
    lambda b: graph.edges_between(b.edges(), b.edges())
)
query(
    "invalidation_candidates",
    """, h AS (SELECT a.uuid AS query_uuid, b.uuid, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score FROM vedge a JOIN vedge b
       ON a.group_id = b.group_id AND a.uuid <> b.uuid AND (a.s IN (b.s, b.t) OR a.t IN (b.s, b.t)) WHERE (1 + list_cosine_similarity(a.v, b.v)) / 2 > 0.6)
       SELECT query_uuid, uuid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_uuid ORDER BY score DESC, uuid) AS r FROM h) WHERE r <= 10""",
)(lambda b: search.invalidation_candidates(b.vector_edges(), b.vector_edges(), "embedding").withColumn("score", r6(F.col("score"))))
query(
    "relevant_nodes",
    """SELECT query_uuid, uuid, round(score, 6) AS score FROM (SELECT a.uuid AS query_uuid, b.uuid, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score,
       row_number() OVER (PARTITION BY a.uuid ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.uuid) AS r FROM vnode a JOIN vnode b ON a.group_id = b.group_id AND a.uuid <> b.uuid
       WHERE (1 + list_cosine_similarity(a.v, b.v)) / 2 > 0.6) WHERE r <= 5""",
)(lambda b: search.relevant_nodes(b.vector_nodes(), b.vector_nodes(), "embedding", limit=5).withColumn("score", r6(F.col("score"))))
query(
    "edge_dup_candidates",
    """, w AS (SELECT *, string_split_regex(fact, ' +') AS ws FROM vedge)
       SELECT a.uuid AS a, b.uuid AS b FROM w a JOIN w b ON a.s = b.s AND a.t = b.t AND a.uuid < b.uuid WHERE list_has_any(a.ws, b.ws) OR list_cosine_similarity(a.v, b.v) >= 0.6""",
)(lambda b: resolve.duplicate_candidates(b.vector_edges(), "embedding"))
query("name_match_exact", "SELECT a.norm, sum(a.n) AS count_a, max(b.m) AS count_b FROM ncn a JOIN (SELECT lower(p_name) AS norm, count(*) AS m FROM part GROUP BY 1) b ON a.norm = b.norm GROUP BY 1")(
    lambda b: resolve.matched_names(b.name_counts().withColumn("norm", T.normalize_relation(F.col("name"))), b.part_names().select(T.norm_exact(F.col("name")).alias("norm"), F.lit(1).alias("count")))
)
query("name_match_unmatched", "SELECT DISTINCT lower(c_name) AS norm FROM customer WHERE lower(c_name) NOT IN (SELECT lower(replace(s_name, 'Supplier', 'Customer')) FROM supplier)")(
    lambda b: resolve.unmatched_names(b.table("customer").select(T.norm_exact(F.col("c_name")).alias("norm")), b.table("supplier").select(T.norm_exact(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("norm")))
)
query(
    "backmap",
    """, g AS (SELECT norm, arg_min(name, (-length(name), name)) AS group_name FROM ncn GROUP BY 1)
       SELECT ncn.name, ncn.n AS count, mp.cluster_id, representative FROM ncn JOIN g ON ncn.norm = g.norm JOIN mp ON mp.name = g.group_name JOIN mprep ON mp.cluster_id = mprep.cluster_id""",
)(lambda b: canon.backmap(b.name_counts(), b.mapping().join(canon.representatives(b.mapping()), "cluster_id").drop("count")))
query(
    "allowed_edge_types",
    "SELECT edge.uuid, CASE WHEN edge.name = 'ORDERED_R' OR (edge.name = 'ORDERED_A' AND ent.name LIKE 'red%') THEN 'RELATES_TO' ELSE edge.name END AS name FROM edge JOIN ent ON ent.uuid = t",
)(
    lambda b: resolve.allowed_edge_types(
        b.edges().select("uuid", "source_node_uuid", "target_node_uuid", "name"),
        b.entities().withColumn("labels", F.when(F.col("name").startswith("red"), F.array(F.lit("Red"))).otherwise(F.col("labels"))),
        b.spark.createDataFrame([("Customer", "Part", "ORDERED_A"), ("Customer", "Supplier", "ORDERED_R")], "src_label string, dst_label string, edge_type string"),
        ["ORDERED_A", "ORDERED_R"],
    )
)
query("filter_existing_duplicates", "SELECT uuid FROM edge WHERE (s, t) NOT IN (SELECT s, t FROM edge WHERE name = 'ORDERED_A')")(lambda b: resolve.without_known_duplicates(b.edges(), b.edges(), "ORDERED_A").select("uuid"))
query("nodes_edges_by_episode", "SELECT ep AS episode, 'edge' AS kind, uuid FROM edge UNION ALL SELECT s, 'node', t FROM ment")(
    lambda b: b.edges().select(F.explode("episodes").alias("episode"), F.lit("edge").alias("kind"), "uuid").unionByName(
        b.mentions().select(F.col("source_node_uuid").alias("episode"), F.lit("node").alias("kind"), F.col("target_node_uuid").alias("uuid"))
    )
)

# ---- aggregations, ranks, sets ----------------------------------------------------------------------------------

query(
    "relation_counts",
    r"""WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
       SELECT name, count(*) AS count FROM (SELECT w[i] || '_' || w[i + 1] AS name FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY 1""",
    bare=True,
)(lambda b: canon.counts(b.relation_rows()))
query("exact_normalized_groups", "SELECT norm AS normalized, sum(n) AS total_count, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 5), ', ') AS examples FROM ncn GROUP BY 1")(lambda b: canon.exact_groups(b.name_counts()))
query("group_by_normalized", "SELECT norm AS normalized, sum(n) AS count, count(*) AS members, arg_min(name, (-length(name), name)) AS name FROM ncn GROUP BY 1")(lambda b: canon.group_by_normalized(b.name_counts()))
query("rebuild_collapsed", "SELECT sizes.cluster_id, representative, total_count, members FROM sizes JOIN mprep ON sizes.cluster_id = mprep.cluster_id")(lambda b: canon.collapsed(b.mapping()))
query("nodes_by_date", "SELECT strftime(valid_at, '%Y-%m-%d') AS day, count(*) AS n FROM episode GROUP BY 1")(lambda b: report.counts_by(b.episodes(), day("valid_at"), "day"))
query("entity_counts", "SELECT name, count(*) AS n FROM ent GROUP BY 1")(lambda b: report.counts_by(b.entities(), "name", "name"))
query("cluster_stats", "SELECT count(*) AS clusters, sum(total_count) AS edges, round(avg(total_count), 6) AS avg_edges, round(avg(members), 6) AS avg_names FROM sizes")(
    lambda b: report.cluster_stats(canon.collapsed(b.mapping())).select("clusters", "edges", r6(F.col("avg_edges")).alias("avg_edges"), r6(F.col("avg_names")).alias("avg_names"))
)
query("retention_ratio", "SELECT (SELECT count(*) FROM sizes) AS clusters, (SELECT count(DISTINCT name) FROM nc) AS names, round((SELECT count(*) FROM sizes)::DOUBLE / (SELECT count(DISTINCT name) FROM nc), 6) AS ratio")(
    lambda b: report.retention(canon.collapsed(b.mapping()), b.name_counts()).withColumn("ratio", r6(F.col("ratio")))
)
query("cluster_entropy", "SELECT round(-sum(p * log2(p)), 6) AS bits, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalized FROM (SELECT total_count::DOUBLE / sum(total_count) OVER () AS p FROM sizes)")(
    lambda b: report.entropy(canon.collapsed(b.mapping())).select(r6(F.col("bits")).alias("bits"), r6(F.col("normalized")).alias("normalized"))
)
query("neighbor_projection", "SELECT uuid, neighbour, count(*) AS weight FROM (SELECT s AS uuid, t AS neighbour FROM edge UNION ALL SELECT t, s FROM edge) WHERE uuid <> neighbour GROUP BY ALL")(lambda b: graph.neighbours(b.edges()))
query("mention_counts", "SELECT t AS uuid, count(*) AS mentions FROM ment GROUP BY 1")(lambda b: search.mention_counts(b.mentions()))
query(
    "entity_community_mode",
    """, v AS (SELECT n.s AS uuid, memb.s AS community, count(*) AS n FROM (SELECT DISTINCT s, t FROM edge) n JOIN memb ON n.t = memb.t GROUP BY ALL)
       SELECT uuid, community, n FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY n DESC, community) AS r FROM v) WHERE r = 1""",
)(lambda b: graph.community_mode(graph.neighbours(b.edges()), b.members()))
query(
    "cluster_centroids",
    """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
       l AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY 1) SELECT m.label, i - 1 AS position, round(x / (l + 1e-9), 6) AS value FROM m JOIN l ON m.label = l.label""",
    bare=True,
)(lambda b: canon.centroids(b.table("embeddings"), "label", "embedding").select("label", long("position").alias("position"), r6(F.col("value")).alias("value")))
MESSAGES = [("Pydantic validation failed: JSON parsing error from Ollama", 1), ("Using empty fallback structure instead", 2), ("JSONDecodeError from Ollama at 3", 3), ("Unexpected response type from Ollama", 4), ("pydantic validation, in small letters", 5), ("a core exception, then Using empty fallback structure instead", 6)]
query(
    "error_buckets",
    """, m AS (SELECT CASE CAST(substr(uuid, 2) AS BIGINT) % 7 """
    + " ".join(f"WHEN {i} THEN '{t}'" for t, i in MESSAGES)
    + """ ELSE 'request timed out' END AS m FROM episode WHERE source = 'error')
       SELECT CASE WHEN contains(m, 'Pydantic validation') THEN 'Pydantic validation' WHEN contains(m, 'Using empty fallback structure instead') THEN 'Fallback empty structure'
         WHEN contains(m, 'JSON parsing error from Ollama') OR contains(m, 'JSONDecodeError from Ollama') THEN 'JSON parsing error' WHEN contains(m, 'Unexpected response type from Ollama') THEN 'Unexpected type'
         WHEN contains(m, 'core exception') THEN 'Core exception' ELSE 'Other' END AS bucket, count(*) AS n FROM m GROUP BY 1""",
)(
    lambda b: (
        lambda k: report.counts_by(
            b.episodes().where("source = 'error'"), report.error_bucket(F.coalesce(*(F.when(k == i, F.lit(t)) for t, i in MESSAGES), F.lit("request timed out"))), "bucket"
        )
    )(F.substr("uuid", F.lit(2)).cast("long") % 7)
)
query("run_sums", "SELECT 'u' || (user_id % 9) AS run, count(*) AS chunks, sum(event_id % 4) AS errors, sum(event_id % 3) AS warnings, sum(event_id) AS seconds, round(sum(event_id % 4)::DOUBLE / count(*), 6) AS errors_per_chunk FROM events GROUP BY 1", bare=True)(
    lambda b: report.run_sums(
        b.table("events").select(F.concat(F.lit("u"), F.col("user_id") % 9).alias("run"), F.lit(1).alias("chunks"), (F.col("event_id") % 4).alias("errors"), (F.col("event_id") % 3).alias("warnings"), F.col("event_id").alias("seconds")), ["run"]
    ).withColumn("errors_per_chunk", r6(F.col("errors_per_chunk")))
)
query("distinct_share", "SELECT p_brand AS brand, count(DISTINCT p_name) AS \"distinct\", count(*) AS total, round(count(*)::DOUBLE / count(DISTINCT p_name), 6) AS per_distinct FROM part GROUP BY 1", bare=True)(
    lambda b: report.distinct_share(b.table("part").withColumnRenamed("p_brand", "brand"), "p_name", ["brand"]).withColumn("per_distinct", r6(F.col("per_distinct")))
)
query("merge_checkpoints", "SELECT user_id, arg_max(event_id, ('chunk_' || (event_id % 12), event_id)) AS event_id, max('chunk_' || (event_id % 12)) AS chunk FROM events GROUP BY 1")(
    lambda b: report.latest_by_chunk(b.table("events").select("user_id", "event_id", F.concat(F.lit("chunk_"), F.col("event_id") % 12).alias("chunk")), ["user_id"])
)
query("hist_overflow", "SELECT CASE WHEN n > 40 THEN 41 ELSE n END AS bin, count(*) AS n FROM (SELECT s, count(*) AS n FROM edge GROUP BY 1) GROUP BY 1")(
    lambda b: report.histogram_overflow(b.edges().groupBy("source_node_uuid").agg(F.count(F.lit(1)).alias("c")), "c", 40)
)
query("hist_logbins", "SELECT CAST(floor(log2(n) + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM (SELECT s, count(*) AS n FROM edge GROUP BY 1) GROUP BY 1")(
    lambda b: report.histogram_log(b.edges().groupBy("source_node_uuid").agg(F.count(F.lit(1)).alias("c")), "c")
)
query("edge_count_cdf", "SELECT n AS value, round(row_number() OVER (ORDER BY n) / count(*) OVER (), 6) AS cdf FROM (SELECT s, count(*) AS n FROM edge GROUP BY 1)")(
    lambda b: report.cdf_rows(b.edges().groupBy("source_node_uuid").agg(F.count(F.lit(1)).alias("c")), "c", Lineage(b.spark)).withColumn("cdf", r6(F.col("cdf")))
)
query("edge_count_cdf_tied", "SELECT v AS value, k AS n, round(sum(k) OVER (ORDER BY v) / sum(k) OVER (), 6) AS cdf FROM (SELECT n AS v, count(*) AS k FROM (SELECT s, count(*) AS n FROM edge GROUP BY 1) GROUP BY 1)")(
    lambda b: report.cdf(b.edges().groupBy("source_node_uuid").agg(F.count(F.lit(1)).alias("c")), "c").withColumn("cdf", r6(F.col("cdf")))
)
query("dup_norm_names", "SELECT norm, count(*) AS n FROM ncn GROUP BY 1 HAVING count(*) > 1")(
    lambda b: report.repeated_keys(b.name_counts(), T.normalize_relation(F.col("name")), "norm")
)
query("choose_rep", "SELECT * FROM mprep")(lambda b: canon.representatives(b.mapping()))
query("best_by_norm", "SELECT norm, arg_min(name, (-n, name)) AS name, max(n) AS count FROM ncn GROUP BY 1")(
    lambda b: canon.best_of_group(b.name_counts())
)
query("top_items", "SELECT cluster_id, name, n AS count, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, name) AS r FROM mp) WHERE r <= 3")(
    lambda b: canon.ranked_in(b.mapping(), 3).withColumn("rank", long("rank"))
)
query("topk_clusters", "SELECT cluster_id, total_count FROM sizes ORDER BY total_count DESC, cluster_id LIMIT 5")(
    lambda b: canon.largest_clusters(canon.collapsed(b.mapping()), 5).select("cluster_id", "total_count")
)
query(
    "pair_candidates_topk",
    """SELECT a, b, round(d, 6) AS distance FROM (SELECT a.uuid AS a, b.uuid AS b, 1 - list_cosine_similarity(a.v, b.v) AS d FROM vedge a JOIN vedge b ON a.uuid < b.uuid) ORDER BY d, a, b LIMIT 200""",
)(lambda b: canon.nearest_pairs(b.vector_edges(), "embedding", 200).withColumn("distance", r6(F.col("distance"))))
query(
    "candidate_union_dedupe",
    """SELECT uuid, min(l) AS list, CAST(arg_min(o, (l, o)) AS BIGINT) AS ord FROM (SELECT uuid, 0 AS l, c AS o FROM (SELECT 'p' || p_partkey AS uuid, p_partkey AS c FROM part WHERE p_partkey % 3 = 0)
       UNION ALL SELECT 'p' || p_partkey, 1, -p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY 1""",
)(
    lambda b: resolve.union_candidates(
        b.table("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.col("p_partkey").alias("ord")),
        b.table("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), (-F.col("p_partkey")).alias("ord")),
    )
)
query(
    "name_set_ops",
    """, a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0), z AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 45)
       SELECT 'both' AS side, name FROM (SELECT * FROM a INTERSECT SELECT * FROM z) UNION ALL SELECT 'left', name FROM (SELECT * FROM a EXCEPT SELECT * FROM z)""",
)(
    lambda b: (
        lambda a, z: a.intersect(z).select(F.lit("both").alias("side"), "name").unionByName(a.subtract(z).select(F.lit("left").alias("side"), "name"))
    )(b.table("part").where("p_partkey % 2 = 0").select(F.col("p_name").alias("name")), b.table("part").where("p_size > 45").select(F.col("p_name").alias("name")))
)

# ---- retrieval --------------------------------------------------------------------------------------------------


def bm25_sql(rows: str, text: str, terms: list[str]) -> str:
    """SQL for search.bm25: ``rows`` is a table with uuid, ``text`` an expression."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(terms)))
    part = lambda i: f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    return rf""", tk AS (SELECT uuid, list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {rows}),
      tfs AS (SELECT uuid, len(w)::DOUBLE AS dl, {tf} FROM tk), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM tfs),
      bm AS (SELECT uuid, {" + ".join(map(part, range(len(terms))))} AS score FROM tfs, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))})"""


def scored(df: DataFrame) -> DataFrame:
    return df.select("uuid", r6(F.col("score")).alias("score"))


BM = " SELECT uuid, round(score, 6) AS score FROM bm"
query("bm25_edges", bm25_sql("fact", "fact", ["red", "widget"]) + BM)(lambda b: scored(search.bm25(b.facts(), "red widget", ["fact"])))


def indexed(b: Bound) -> TextIndex:
    """The facts in a store and their index, which saw some facts under other texts and some that are gone before."""
    versions = Versions(b.spark, f"{Lineage(b.spark).path}/store", {"facts": "uuid string, fact string"}, 8)
    index, facts = TextIndex(versions, "facts", ["fact"]), Lineage(b.spark).cut(b.facts().select("uuid", "fact"))  # four changes read them
    number = F.crc32(F.encode("uuid", "utf-8"))
    versions.change(lambda c: c.upsert("facts", facts.select("uuid", F.when(number % 5 == 0, F.concat(F.lit("red widget "), "fact")).otherwise(F.col("fact")).alias("fact"))))
    index.refresh()
    versions.change(lambda c: (c.upsert("facts", facts.where(number % 5 == 0)), c.delete("facts", facts.where(number % 64 == 1))))
    versions.change(lambda c: c.upsert("facts", facts.where(number % 64 == 1)))
    index.refresh()
    return index


query("bm25_edges_indexed", bm25_sql("fact", "fact", ["red", "widget"]) + BM)(lambda b: scored(indexed(b).search("red widget", (1 << 31) - 1)))
query("bm25_edges_indexed_top", bm25_sql("fact", "fact", ["red", "gear", "customer"]) + " SELECT row_number() OVER (ORDER BY round(score, 6) DESC) AS place, round(score, 6) AS score FROM bm QUALIFY place <= 50")(
    lambda b: indexed(b).search("red gear customer", 50).select(F.row_number().over(Window.orderBy(F.desc("score"))).cast("long").alias("place"), r6(F.col("score")).alias("score"))
)
query("bm25_nodes", bm25_sql("ent", "name || ' ' || summary", ["red", "economy"]) + BM)(lambda b: scored(search.bm25(b.entities(), "red economy", ["name", "summary"])))
query("bm25_episodes", bm25_sql("msg", "content", ["the", "und"]) + BM)(lambda b: scored(search.bm25(b.messages(), "the und", ["content"])))
query("bm25_communities", bm25_sql("comm", "name", ["brand", "7"]) + BM)(lambda b: scored(search.bm25(b.communities(), "brand 7", ["name"])))
SANITIZED = r"regexp_replace({}, '([+\-&|!(){{}}\[\]^\"~*?:\\/ORNTAD])', '\\\1', 'g')"
query("lucene_sanitize", f"SELECT item_id, {SANITIZED.format('text')} AS text FROM benchmark", bare=True)(lambda b: b.table("benchmark").select("item_id", T.lucene_sanitize(F.col("text")).alias("text")))
query(
    "falkor_fulltext_query",
    r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(text, '[,.<>{}\[\]"'':;!@#$%^&*()\-+=~?|/\\]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
         lambda x: x <> '' AND lower(x) NOT IN ('a','is','the','an','and','are','as','at','be','but','by','for','if','in','into','it','no','not','of','on','or','such','that','their','then','there','these','they','this','to','was','will','with')) AS w FROM benchmark)
       SELECT item_id, CASE WHEN len(w) * 2 - 1 >= 128 THEN '' ELSE array_to_string(w, ' | ') END AS query FROM w""",
    bare=True,
)(lambda b: b.table("benchmark").select("item_id", T.fulltext_query(F.col("text")).alias("query")))
query("edge_similarity", "SELECT uuid, round((1 + list_cosine_similarity(v, q)) / 2, 6) AS score FROM vedge, q0 WHERE (1 + list_cosine_similarity(v, q)) / 2 > 0.6 ORDER BY (1 + list_cosine_similarity(v, q)) / 2 DESC, uuid LIMIT 10")(
    lambda b: scored(search.similarity(b.vector_edges(), b.query_vector(), "embedding"))
)
query("node_similarity", "SELECT uuid, round(list_cosine_similarity(v, q), 6) AS score FROM vnode, q0 WHERE list_cosine_similarity(v, q) > 0.2 ORDER BY list_cosine_similarity(v, q) DESC, uuid LIMIT 20")(
    lambda b: scored(search.similarity(b.vector_nodes(), b.query_vector(), "embedding", 0.2, 20, "raw"))
)
CENTRES = """, m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL)"""
query(
    "community_similarity",
    CENTRES + """, k AS (SELECT 'l' || label AS uuid, (1 + sum(x * q[i]) / sqrt(sum(x * x)) / sqrt(sum(q[i] * q[i]))) / 2 AS score FROM m, q0 GROUP BY label)
       SELECT uuid, round(score, 6) AS score FROM k WHERE score > 0.6 ORDER BY k.score DESC, uuid LIMIT 10""",
)(lambda b: scored(search.similarity(b.label_communities(), b.query_vector(), "embedding")))
REACH = """, w AS (SELECT uuid, s, t, 1 AS hop FROM big WHERE s IN (SELECT o FROM orig) UNION SELECT big.uuid, big.s, big.t, hop + 1 FROM w JOIN big ON big.s = w.t WHERE hop < 3)"""
WEB = """, big AS (SELECT 'a' || o_orderkey AS uuid, 'n' || o_custkey AS s, 'n' || ((o_custkey * 7 + o_orderkey) % 1500) AS t FROM orders),
 orig AS (SELECT 'n' || c_custkey AS o FROM customer WHERE c_custkey IN (1, 2, 3))"""


def web(b: Bound) -> tuple[DataFrame, DataFrame]:
    """A graph with paths, from orders, and three origins."""
    n = F.concat(F.lit("n"), (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500)
    edges = b.table("orders").select(F.concat(F.lit("a"), "o_orderkey").alias("uuid"), F.concat(F.lit("n"), "o_custkey").alias("source_node_uuid"), n.alias("target_node_uuid"))
    return edges, b.table("customer").where("c_custkey in (1, 2, 3)").select(F.concat(F.lit("n"), "c_custkey").alias("uuid"))


def grouped_web(b: Bound) -> tuple[DataFrame, DataFrame, DataFrame]:
    """That graph with three episodes that mention nodes; all six are origins. Nodes have groups, the episodes one of theirs."""
    edges, origins = web(b)
    group = F.concat(F.lit("g"), F.substring("uuid", 2, 20).cast("int") % 3).alias("group_id")
    three = b.table("customer").where("c_custkey in (1, 2, 3)")
    said = three.select(F.concat(F.lit("x"), "c_custkey").alias("source_node_uuid"), F.concat(F.lit("n"), F.col("c_custkey") + 3).alias("target_node_uuid"))
    links = edges.select("source_node_uuid", "target_node_uuid").unionByName(said)
    places = origins.select("uuid", group).unionByName(said.select(F.col("source_node_uuid").alias("uuid"), F.lit("g0").alias("group_id")))
    return links, places, b.table("customer").select(F.concat(F.lit("n"), "c_custkey").alias("uuid")).select("uuid", group)


query("edge_bfs", WEB + REACH + " SELECT uuid, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY 1")(lambda b: graph.edges_within(*web(b), 3, Lineage(b.spark)).select("uuid", long("hop").alias("hop")))
query(
    "node_bfs",
    WEB + """, said AS (SELECT 'x' || c_custkey AS s, 'n' || (c_custkey + 3) AS t FROM customer WHERE c_custkey IN (1, 2, 3)), lk AS (SELECT s, t FROM big UNION ALL SELECT * FROM said),
       og AS (SELECT o AS u, 'g' || (CAST(substr(o, 2) AS INT) % 3) AS g FROM orig UNION ALL SELECT s, 'g0' FROM said),
       w AS (SELECT t, g, 1 AS hop FROM og JOIN lk ON s = u UNION SELECT lk.t, g, hop + 1 FROM w JOIN lk ON lk.s = w.t WHERE hop < 3)
       SELECT t AS uuid, CAST(min(hop) AS BIGINT) AS hop FROM w JOIN customer ON t = 'n' || c_custkey AND g = 'g' || (c_custkey % 3) GROUP BY 1""",
)(lambda b: graph.nodes_of_group_within(*grouped_web(b), 3, Lineage(b.spark)).select("uuid", long("hop").alias("hop")))
HYBRID = bm25_sql("vnode", "name || ' ' || summary", ["household", "building"]) + """, l AS (
  SELECT uuid, 0 AS m, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS r FROM bm UNION ALL SELECT uuid, 1, row_number() OVER (ORDER BY list_cosine_similarity(v, q) DESC, uuid) - 1 FROM vnode, q0 WHERE (1 + list_cosine_similarity(v, q)) / 2 > 0.6),
  f AS (SELECT uuid, sum(1 / (r + 1)::DOUBLE) AS score, min((m, r)) AS seen FROM l WHERE r < 20 GROUP BY 1)"""
query("hybrid_node_search", HYBRID + " SELECT uuid, round(score, 6) AS score FROM f")(
    lambda b: scored(
        search.rrf(
            search.ranked(search.bm25(b.vector_nodes(), "household building", ["name", "summary"], 20), 0).unionByName(search.ranked(search.similarity(b.vector_nodes(), b.query_vector(), "embedding", 0.6, 20), 1))
        )
    )
)
query("search_nodes_hybrid_rrf", HYBRID + " SELECT uuid, round(score, 6) AS score FROM f ORDER BY f.score DESC, seen LIMIT 10")(
    lambda b: scored(search.hybrid(b.vector_nodes(), "household building", b.query_vector(), ["name", "summary"], "embedding", search.RECIPES["nodes_rrf"].nodes))
)
EHYBRID = bm25_sql("vedge", "fact", ["about", "3"]) + """, l AS (
  SELECT uuid, 0 AS m, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS r FROM bm UNION ALL SELECT uuid, 1, row_number() OVER (ORDER BY list_cosine_similarity(v, q) DESC, uuid) - 1 FROM vedge, q0 WHERE (1 + list_cosine_similarity(v, q)) / 2 > 0.6),
  f AS (SELECT uuid, sum(1 / (r + 1)::DOUBLE) AS score, min((m, r)) AS seen FROM l WHERE r < 20 GROUP BY 1)"""
query("search_edges_hybrid_rrf", EHYBRID + " SELECT uuid, round(score, 6) AS score FROM f ORDER BY f.score DESC, seen LIMIT 10")(
    lambda b: scored(search.hybrid(b.vector_edges(), "about 3", b.query_vector(), ["fact"], "embedding", search.RECIPES["edges_rrf"].edges))
)

query(
    "rrf",
    """, l AS (SELECT 'p' || p_partkey AS uuid, 0 AS m, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS r FROM part UNION ALL SELECT 'p' || p_partkey, 1, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 FROM part WHERE p_size > 10)
       SELECT uuid, round(sum(1 / (r + 1)::DOUBLE), 6) AS score FROM l GROUP BY 1""",
)(
    lambda b: (
        lambda p: scored(
            search.rrf(
                p.select("uuid", F.lit(0).alias("method"), (F.row_number().over(Window.orderBy(F.desc("p_size"), "p_partkey")) - 1).alias("rank")).unionByName(
                    p.where("p_size > 10").select("uuid", F.lit(1).alias("method"), (F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")) - 1).alias("rank"))
                )
            )
        )
    )(b.table("part").withColumn("uuid", F.concat(F.lit("p"), "p_partkey")))
)
query(
    "mmr",
    """, f AS (SELECT uuid, v, list_cosine_similarity(v, q) AS s FROM vedge, q0 ORDER BY s DESC, uuid LIMIT 50), c AS (SELECT uuid, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM f),
       k AS (SELECT a.uuid, greatest(0, max(list_dot_product(a.v, b.v))) AS m FROM c a JOIN c b ON a.uuid <> b.uuid GROUP BY 1)
       SELECT c.uuid, round(0.5::DOUBLE * list_dot_product(v, q) - 0.5::DOUBLE * m, 6) + 0.0::DOUBLE AS score FROM c JOIN k ON c.uuid = k.uuid, q0""",
)(lambda b: scored(search.mmr(search.similarity(b.vector_edges(), b.query_vector(), "embedding", -2.0, 50, "raw"), b.query_vector())).withColumn("score", F.col("score") + 0.0))  # no negative zero
query("node_distance", ", near AS (SELECT t AS u FROM edge WHERE s = 'c1' UNION SELECT s FROM edge WHERE t = 'c1') SELECT uuid, CASE WHEN uuid = 'c1' THEN 10.0 WHEN uuid IN (SELECT u FROM near) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM ent")(
    lambda b: search.node_distance(b.entities(), b.edges(), "c1")
)
query("episode_mentions_nodes", "SELECT ent.uuid, coalesce(n, 'Infinity'::DOUBLE)::DOUBLE AS mentions FROM ent LEFT JOIN (SELECT t, count(*) AS n FROM ment GROUP BY 1) m ON ent.uuid = t")(
    lambda b: search.by_mentions(b.entities(), b.mentions())
)

query(
    "cross_encoder_stub",
    r""", l AS (SELECT name, max(uuid) AS uuid FROM ent GROUP BY 1)
       SELECT uuid, len(list_intersect(['red', 'widget'], list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '')))::DOUBLE / 2 AS score FROM l""",
)(lambda b: search.cross_encoded(b.entities(), "red widget", "name"))

# ---- time -------------------------------------------------------------------------------------------------------

query("retrieve_episodes", "SELECT uuid, group_id, row_number() OVER (PARTITION BY group_id ORDER BY valid_at, uuid) AS position FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY valid_at DESC, uuid DESC) AS r FROM episode WHERE valid_at <= TIMESTAMP '2024-01-15') WHERE r <= 3")(
    lambda b: temporal.retrieve_episodes(b.episodes(), "2024-01-15", 3, "group_id").select("uuid", "group_id", long("position").alias("position"))
)
query("previous_episodes", "SELECT uuid, group_id, array_to_string(list(uuid) OVER (PARTITION BY group_id ORDER BY valid_at, uuid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS previous FROM episode")(
    lambda b: temporal.previous_episodes(b.episodes()).withColumn("previous", joined("previous"))
)
PAIRS = """, pr AS (SELECT e.uuid AS e_uuid, n.uuid AS n_uuid, e.valid_at AS ev, e.invalid_at AS ei, n.valid_at AS nv, n.invalid_at AS ni FROM ended e JOIN ended n ON e.s = n.s AND e.t = n.t AND e.uuid <> n.uuid)"""


def fact_pairs(b: Bound) -> DataFrame:
    e, n = b.ended_edges(), b.ended_edges()
    side = lambda df, p: df.select(F.col("uuid").alias(f"{p}_uuid"), "source_node_uuid", "target_node_uuid", F.col("valid_at").alias(f"{p}_valid_at"), F.col("invalid_at").alias(f"{p}_invalid_at"))
    return side(e, "e").join(side(n, "n"), ["source_node_uuid", "target_node_uuid"]).where("e_uuid <> n_uuid").withColumn("e_expired_at", F.lit(None).cast("timestamp"))


query(
    "edge_contradictions",
    PAIRS
    + """ SELECT e_uuid, n_uuid, k AS invalidated, strftime(CASE WHEN k THEN nv ELSE ei END, '%Y-%m-%d') AS new_invalid_at, CASE WHEN k THEN '2025-01-01' END AS new_expired_at
       FROM (SELECT *, NOT coalesce(ei <= nv, false) AND NOT coalesce(ni <= ev, false) AND coalesce(ev < nv, false) AS k FROM pr)""",
)(
    lambda b: temporal.contradicted(fact_pairs(b), "2025-01-01").select("e_uuid", "n_uuid", "invalidated", day("new_invalid_at").alias("new_invalid_at"), day("new_expired_at").alias("new_expired_at"))
)
query(
    "expire_new_edge",
    """, c AS (SELECT a.uuid, min(b.valid_at) AS nx FROM edge a JOIN edge b ON a.s = b.s AND a.t = b.t AND b.valid_at > a.valid_at GROUP BY 1)
       SELECT edge.uuid, strftime(nx, '%Y-%m-%d') AS invalid_at, CASE WHEN nx IS NOT NULL THEN '2025-01-01' END AS expired_at FROM edge LEFT JOIN c ON edge.uuid = c.uuid""",
)(
    lambda b: temporal.expire_new(
        b.edges().withColumn("invalid_at", F.lit(None).cast("timestamp")).withColumn("expired_at", F.lit(None).cast("timestamp")),
        b.edges().select(F.col("uuid").alias("new_uuid"), "source_node_uuid", "target_node_uuid").join(b.edges().select("source_node_uuid", "target_node_uuid", "valid_at"), ["source_node_uuid", "target_node_uuid"]).select("new_uuid", "valid_at"),
        "2025-01-01",
    ).select("uuid", day("invalid_at").alias("invalid_at"), day("expired_at").alias("expired_at"))
)
query("facts_as_of", "SELECT uuid, name FROM ended WHERE valid_at <= TIMESTAMP '1998-06-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-06-01')")(lambda b: temporal.as_of(b.ended_edges(), "1998-06-01").select("uuid", "name"))
query("episodic_edges", "SELECT DISTINCT 'me_' || s || '_' || t AS uuid, s AS source_node_uuid, t AS target_node_uuid FROM ment")(lambda b: graph.membership_edges(b.mentions(), "me_"))
POINT = """, pt AS (SELECT 'p' || p_partkey AS u, 'p' || min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part)"""


def part_pointers(b: Bound) -> DataFrame:
    p = b.table("part").select("p_partkey", "p_name")
    return p.join(p.groupBy("p_name").agg(F.min("p_partkey").alias("m")), "p_name").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.concat(F.lit("p"), "m").alias("canonical"))


query("edge_pointers", POINT + " SELECT uuid, s AS source_node_uuid, coalesce(c, t) AS target_node_uuid FROM edge LEFT JOIN pt ON t = u")(
    lambda b: graph.repoint(b.edges().select("uuid", "source_node_uuid", "target_node_uuid"), part_pointers(b))
)
query("edge_fast_dedupe", "SELECT arg_min(uuid, (created_at, uuid)) AS uuid, s AS source_node_uuid, t AS target_node_uuid FROM fact GROUP BY s, t, lower(fact)")(
    lambda b: temporal.first_of_each(b.facts(), T.norm_exact(F.col("fact"))).select("uuid", "source_node_uuid", "target_node_uuid")
)
query(
    "edge_verbatim_reuse",
    """, r AS (SELECT a.uuid, min(b.uuid) AS reused, min(a.ep) AS ep FROM fact a LEFT JOIN fact b ON a.s = b.s AND a.t = b.t AND lower(a.fact) = lower(b.fact) AND b.name = 'ORDERED_A' WHERE a.name <> 'ORDERED_A' GROUP BY 1)
       SELECT r.uuid, reused, CASE WHEN o.ep IS NOT NULL AND o.ep <> r.ep THEN o.ep || ',' || r.ep ELSE r.ep END AS episodes FROM r LEFT JOIN fact o ON o.uuid = reused""",
)(
    lambda b: temporal.reuse_verbatim(b.facts().where("name <> 'ORDERED_A'"), b.facts().where("name = 'ORDERED_A'"), T.norm_exact)
    .join(b.facts().select("uuid", F.col("episodes").alias("own")), "uuid")
    .select("uuid", "reused", joined(F.coalesce("episodes", "own")).alias("episodes"))
)
query(
    "reused_episodes",
    """, r AS (SELECT b.uuid AS reused, list_sort(list(DISTINCT a.ep)) AS eps FROM (SELECT *, min(uuid) OVER (PARTITION BY s, t) AS head FROM fact WHERE name = 'ORDERED_A') b JOIN fact a ON a.s = b.s AND a.t = b.t AND a.name <> 'ORDERED_A' WHERE b.uuid = head GROUP BY 1)
       SELECT fact.uuid, CASE WHEN eps IS NULL THEN ep ELSE array_to_string(list_concat([ep], list_filter(eps, lambda x: x <> ep)), ',') END AS episodes FROM fact LEFT JOIN r ON uuid = reused WHERE name = 'ORDERED_A'""",
)(
    lambda b: temporal.with_reused_episodes(
        b.facts().where("name = 'ORDERED_A'"), temporal.reuse_verbatim(b.facts().where("name <> 'ORDERED_A'"), b.facts().where("name = 'ORDERED_A'"), T.norm_exact)
    ).select("uuid", joined("episodes").alias("episodes"))
)
query("ended_by_next", "SELECT uuid, strftime(invalid_at, '%Y-%m-%d') AS invalid_at FROM ended")(
    lambda b: temporal.ended_by_next(b.edges().withColumn("invalid_at", F.lit(None).cast("timestamp")), ["source_node_uuid", "target_node_uuid"]).select("uuid", day("invalid_at").alias("invalid_at"))
)
query(
    "enriched_dates",
    """SELECT uuid, strftime(valid_at, '%Y-%m-%d') AS valid_at, CASE WHEN invalid_at IS NOT NULL THEN strftime(invalid_at, '%Y-%m-%d') WHEN length(uuid) % 2 = 0 THEN '2030-05-06' END AS invalid_at FROM ended""",
)(
    lambda b: temporal.enriched_dates(
        b.ended_edges(), b.edges().select("uuid", F.lit("1900-01-01T00:00:00Z").alias("valid_at"), F.when(F.length("uuid") % 2 == 0, "2030-05-06T07:08:09Z").otherwise("some day").alias("invalid_at"))
    ).select("uuid", day("valid_at").alias("valid_at"), day("invalid_at").alias("invalid_at"))
)
query("contradiction_pass", "SELECT uuid, strftime(invalid_at, '%Y-%m-%d') AS invalid_at FROM ended WHERE name IN ('ORDERED_A', 'ORDERED_R')")(
    lambda b: temporal.with_contradictions(b.ended_edges().where("name = 'ORDERED_A'"), b.edges().where("name <> 'ORDERED_N'").where("name <> 'ORDERED_O'").select("uuid"), b.ended_edges()).select("uuid", day("invalid_at").alias("invalid_at"))
)
query("parse_time", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS t, event_id % 2 = 0 AS known FROM events", bare=True)(
    lambda b: b.table("events").select(
        "event_id", day("ts").alias("t"), temporal.parse_time(F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("no date")).isNotNull().alias("known")
    )
)
query("edge_fact_cosine_dups")(lambda b: resolve.fact_duplicates(b.vector_edges().drop("embedding").join(b.close_vectors(3.0).select(F.concat(F.lit("f"), "vec_id").alias("uuid"), "embedding"), "uuid"), "embedding"))


def order_chain(b: Bound) -> DataFrame:
    """(a, b): every order and the next one of the same customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return b.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("o"), F.lead("o_orderkey").over(w)).alias("b")).where("b is not null")


query("compress_uuid_map", "SELECT 'o' || o_orderkey AS uuid, min('o' || o_orderkey) OVER (PARTITION BY o_custkey) AS canonical FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1", bare=True)(
    lambda b: graph.components(order_chain(b), Lineage(b.spark))
)


def ordered_chain(b: Bound) -> DataFrame:
    """(ord, a, b): every order with the one before it of the same customer, which stands as b where the order is filled."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    this, before = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("o"), F.lag("o_orderkey").over(w))
    filled = F.col("o_orderstatus") == "F"
    return b.table("orders").select(F.col("o_orderkey").alias("ord"), F.when(filled, this).otherwise(before).alias("a"), F.when(filled, before).otherwise(this).alias("b")).where("a is not null and b is not null")


query(
    "ordered_uuid_map",
    """SELECT 'o' || o_orderkey AS uuid,
              'o' || coalesce(max(CASE WHEN n > 1 AND o_orderstatus <> 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey), min(o_orderkey) OVER (PARTITION BY o_custkey)) AS canonical
       FROM (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
       QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""",
    bare=True,
)(lambda b: graph.follow_ordered(ordered_chain(b), Lineage(b.spark)))
query("directed_uuid_map", ", pt AS (SELECT p_partkey AS k FROM part) SELECT 'p' || k AS uuid, 'p' || (k % 10) AS canonical FROM pt WHERE k >= 10")(
    lambda b: graph.follow(b.table("part").where("p_partkey >= 10").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.concat(F.lit("p"), F.col("p_partkey") - 10).alias("canonical")), Lineage(b.spark))
)
query("label_propagation")(lambda b: graph.label_propagation(graph.neighbours(b.links()), Lineage(b.spark)))

# ---- names and entities -----------------------------------------------------------------------------------------

NAMES = "WITH nm AS (SELECT 'p' || p_partkey AS uuid, p_name AS name, '  ' || upper(p_name) || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '  Boxes!' ELSE ' glass-é' END AS raw FROM part) "


def raw_names(b: Bound) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "  Boxes!").otherwise(" glass-é")
    return b.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.concat(F.lit("  "), F.upper("p_name"), tail).alias("raw"))


NX = r"trim(regexp_replace(lower(raw), '\s+', ' ', 'g'))"
query("norm_exact", NAMES + f"SELECT uuid, {NX} AS x FROM nm", bare=True)(lambda b: raw_names(b).select("uuid", T.norm_exact(F.col("raw")).alias("x")))
query(
    "strip_plural",
    NAMES
    + f"""SELECT uuid, array_to_string(list_transform(string_split({NX}, ' '), lambda t: CASE WHEN length(t) > 3 AND t LIKE '%es' AND t NOT LIKE '%sses' THEN substr(t, 1, length(t) - 2)
       WHEN length(t) > 2 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN substr(t, 1, length(t) - 1) ELSE t END), ' ') AS x FROM nm""",
    bare=True,
)(lambda b: raw_names(b).select("uuid", T.strip_plural(F.col("raw")).alias("x")))
NF = rf"trim(regexp_replace(regexp_replace({NX}, '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"
query("norm_fuzzy", NAMES + f"SELECT uuid, {NF} AS x FROM nm", bare=True)(lambda b: raw_names(b).select("uuid", T.norm_fuzzy(F.col("raw")).alias("x")))
ENTROPY = "SELECT uuid, -sum(p * log2(p)) AS h FROM (SELECT uuid, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY uuid) AS p FROM (SELECT uuid, unnest(string_split(replace(name, ' ', ''), '')) AS ch FROM nm) GROUP BY uuid, ch) GROUP BY 1"
query("name_entropy", NAMES + f", h AS ({ENTROPY}) SELECT uuid, round(h, 6) AS h FROM h", bare=True)(lambda b: b.part_names().select("uuid", r6(T.name_entropy(F.col("name"))).alias("h")))
query("high_entropy", NAMES + f", h AS ({ENTROPY}) SELECT h.uuid, h >= 1.5 AND NOT (length(name) < 6 AND len(string_split(name, ' ')) < 2) AS high FROM h JOIN nm ON h.uuid = nm.uuid", bare=True)(
    lambda b: b.part_names().select("uuid", T.high_entropy(F.col("name")).alias("high"))
)
SH = "(SELECT list_distinct([substr(t, i, 3) for i in range(1, length(t) - 1)]))"
SHIN = "sh AS (SELECT uuid, name, list_sort(list_distinct(list_transform(range(1, length(replace(name, ' ', '')) - 1), lambda i: substr(replace(name, ' ', ''), i, 3)))) AS sh FROM nm)"
query("shingles", NAMES + f", {SHIN} SELECT uuid, array_to_string(sh, ',') AS sh FROM sh", bare=True)(lambda b: b.part_names().select("uuid", joined(F.array_sort(T.shingles(F.col("name")))).alias("sh")))
SIG = SHIN + ", sg AS (SELECT uuid, sh, list_transform(range(0, 32), lambda s: list_min(list_transform(sh, lambda x: md5(s || ':' || x)))) AS sg FROM sh)"
query("minhash_signature", NAMES + f", {SIG} SELECT uuid, array_to_string(sg, ',') AS sg FROM sg", bare=True)(lambda b: b.part_names().select("uuid", joined(T.minhash_signature(T.shingles(F.col("name")))).alias("sg")))
DIST = "WITH nm AS (SELECT min('p' || p_partkey) AS uuid, p_name AS name FROM part GROUP BY 2) "
BAND = SIG + ", bd AS (SELECT uuid, sh, unnest(range(0, 8)) AS i, sg FROM sg), bk AS (SELECT uuid, sh, i || '|' || array_to_string(sg[i * 4 + 1:i * 4 + 4], '-') AS band FROM bd), pr AS (SELECT DISTINCT a.uuid AS a, b.uuid AS b, a.sh AS sa, b.sh AS sb FROM bk a JOIN bk b ON a.band = b.band AND a.uuid < b.uuid)"


def distinct_names(b: Bound) -> DataFrame:
    return b.part_names().groupBy("name").agg(F.min("uuid").alias("uuid"))


query("lsh_candidate_pairs", DIST + f", {BAND} SELECT a, b FROM pr", bare=True)(lambda b: resolve.lsh_pairs(distinct_names(b)))
query("jaccard_pairs", DIST + f", {BAND} SELECT a, b, round(len(list_intersect(sa, sb))::DOUBLE / len(list_distinct(list_concat(sa, sb))), 6) AS score FROM pr", bare=True)(
    lambda b: resolve.jaccard_pairs(distinct_names(b)).withColumn("score", r6(F.col("score")))
)
LONG = r"""WITH RECURSIVE ln AS (SELECT 'p' || p_partkey AS uuid, p_partkey AS k, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part),
  xs AS (SELECT 'x' || k AS uuid, CASE k % 4 WHEN 0 THEN upper(name) || '  ' WHEN 1 THEN name || 'y' WHEN 2 THEN 'Unknown thing number ' || k ELSE 'ab' END AS name FROM ln),
  every AS (SELECT uuid, name FROM ln UNION ALL SELECT uuid, name FROM xs), nk AS (SELECT uuid, name, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS e FROM every),
  ks AS (SELECT DISTINCT uuid, e, unnest([e, array_to_string(list_transform(string_split(e, ' '), lambda t: CASE WHEN length(t) > 3 AND t LIKE '%es' AND t NOT LIKE '%sses' THEN substr(t, 1, length(t) - 2)
       WHEN length(t) > 2 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN substr(t, 1, length(t) - 1) ELSE t END), ' ')]) AS key FROM nk),
  fz AS (SELECT DISTINCT e, trim(regexp_replace(regexp_replace(e, '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g')) AS f FROM nk),
  fs AS (SELECT e, f, list_distinct(list_transform(range(1, greatest(length(replace(f, ' ', '')) - 1, 1)), lambda i: substr(replace(f, ' ', ''), i, 3))) AS sh,
    (length(f) >= 6 OR len(string_split(f, ' ')) >= 2) AS enough FROM fz),
  sg AS (SELECT e, sh, list_transform(range(0, 32), lambda s: list_min(list_transform(sh, lambda x: md5(s || ':' || x)))) AS sg FROM fs WHERE enough AND len(sh) > 0),
  bd AS (SELECT e, sh, i || '|' || array_to_string(sg[i * 4 + 1:i * 4 + 4], '-') AS band FROM (SELECT e, sh, sg, unnest(range(0, 8)) AS i FROM sg)),
  pr AS (SELECT DISTINCT a.e AS a, b.e AS b, len(list_intersect(a.sh, b.sh))::DOUBLE / len(list_distinct(list_concat(a.sh, b.sh))) AS score FROM bd a JOIN bd b ON a.band = b.band AND a.e <> b.e)
"""


def altered_names(b: Bound) -> DataFrame:
    """The long names anew: some in capitals, some with a letter more, some unknown, some too short to tell."""
    k = F.col("k") % 4
    name = F.when(k == 0, F.concat(F.upper("name"), F.lit("  "))).when(k == 1, F.concat("name", F.lit("y"))).when(k == 2, F.concat(F.lit("Unknown thing number "), "k")).otherwise("ab")
    return b.long_names().select(F.concat(F.lit("x"), "k").alias("uuid"), name.alias("name"))


query(
    "resolve_entities",
    LONG + """, ex AS (SELECT x.uuid, min(p.uuid) AS canonical FROM ks x JOIN ks p ON x.key = p.key AND x.uuid LIKE 'x%' AND p.uuid LIKE 'p%' GROUP BY 1),
       heads AS (SELECT e, min(uuid) AS uuid FROM nk WHERE uuid LIKE 'p%' GROUP BY 1),
       nr AS (SELECT nk.uuid, heads.uuid AS canonical, row_number() OVER (PARTITION BY nk.uuid ORDER BY score DESC, heads.uuid) AS r FROM nk JOIN pr ON nk.e = pr.a JOIN heads ON heads.e = pr.b
              WHERE nk.uuid LIKE 'x%' AND score >= 0.9 AND nk.uuid NOT IN (SELECT uuid FROM ex))
       SELECT uuid, canonical, 'exact' AS reason FROM ex UNION ALL SELECT uuid, canonical, 'fuzzy' FROM nr WHERE r = 1""",
    bare=True,
)(lambda b: resolve.resolve(altered_names(b), b.long_names().select("uuid", "name")))
query(
    "resolve_guarded",
    """WITH p AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size > 25 THEN 'china' ELSE '' END AS hint, CASE WHEN p_size % 3 > 0 THEN p_type END AS own FROM part),
       x AS (SELECT 'x' || k AS uuid, ['Location', 'People', 'Institution'][k % 3 + 1] AS kind, name, CASE WHEN k % 5 = 0 THEN 'india' WHEN k % 5 < 3 THEN 'china' ELSE '' END AS hint, CASE WHEN k % 4 > 0 THEN own END AS own FROM p),
       h AS (SELECT x.uuid, kind, min('p' || p.k) AS canonical, x.hint AS a, p.hint AS b, x.own AS an, p.own AS bn FROM x JOIN p ON x.name = p.name GROUP BY ALL),
       g AS (SELECT *, CASE kind WHEN 'People' THEN CASE WHEN an IS NULL OR bn IS NULL OR an = bn THEN 'exact' END
         WHEN 'Institution' THEN CASE WHEN a <> '' AND a = b THEN 'exact_ror' WHEN (a <> '') <> (b <> '') THEN 'exact_ror_partial' WHEN an = bn THEN 'exact' WHEN an IS NULL OR bn IS NULL THEN 'exact_institution_partial' END
         ELSE CASE WHEN a <> '' AND a = b THEN 'exact_geo' WHEN (a <> '') <> (b <> '') THEN 'exact_geo_hint_partial' WHEN a = '' AND b = '' THEN 'exact' END END AS reason FROM h)
       SELECT uuid, canonical, reason FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY canonical) AS r FROM g WHERE reason IS NOT NULL) WHERE r = 1""",
    bare=True,
)(
    lambda b: (
        lambda p, k, none, kinds, own: resolve.resolve(
            p.select(F.concat(F.lit("x"), k).alias("uuid"), F.col("p_name").alias("name"), F.element_at(kinds, (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 5 == 0, F.array(F.lit("india"))).when(k % 5 < 3, F.array(F.lit("china"))).otherwise(none).alias("hints"), F.when(k % 4 > 0, own).alias("own")),
            p.select(F.concat(F.lit("p"), k).alias("uuid"), F.col("p_name").alias("name"), F.lit("Location").alias("kind"), F.when(F.col("p_size") > 25, F.array(F.lit("china"))).otherwise(none).alias("hints"), own.alias("own")),
        )
    )(b.table("part"), F.col("p_partkey"), F.array().cast("array<string>"), F.array(F.lit("Location"), F.lit("People"), F.lit("Institution")), F.when(F.col("p_size") % 3 > 0, F.col("p_type")))
)
query("geo_hints", "SELECT c_custkey AS k, array_to_string(list_sort(list_distinct(list_filter([lower(n_name), CASE WHEN c_custkey % 5 = 0 THEN 'spain' END], lambda x: x IN ('china', 'india', 'usa', 'united states', 'france', 'germany', 'spain', 'italy', 'brazil', 'ethiopia')))), ',') AS hints FROM customer JOIN nation ON c_nationkey = n_nationkey", bare=True)(
    lambda b: b.table("customer").join(b.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("k"), joined(F.array_sort(resolve.geo_hints(F.concat(F.lit("Seen in "), "n_name", F.lit(", once")), F.when(F.col("c_custkey") % 5 == 0, F.lit('{"country": " Spain"}'))))).alias("hints")
    )
)
query("ror_hints", "SELECT 's' || s_suppkey AS uuid, CASE WHEN s_suppkey % 4 = 0 THEN 'r' || s_suppkey ELSE '' END AS hints FROM supplier", bare=True)(
    lambda b: resolve.ror_hints(
        b.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uuid"), F.col("s_name").alias("name")),
        b.table("supplier").where("s_suppkey % 4 = 0").select(F.upper("s_name").alias("name"), F.concat(F.lit("r"), "s_suppkey").alias("ror_id")),
    ).select("uuid", joined("hints").alias("hints"))
)
query(
    "merge_safeguard",
    """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Location' WHEN 1 THEN 'People' WHEN 2 THEN 'Institution' ELSE 'Other' END AS kind, CASE WHEN p_size > 25 THEN ['china'] ELSE [] END AS a, CASE WHEN p_partkey % 3 = 0 THEN ['china'] WHEN p_partkey % 3 = 1 THEN ['india'] ELSE [] END AS b, CASE WHEN p_size % 2 = 0 THEN p_type END AS an, p_type AS bn FROM part)
       SELECT k, CASE kind WHEN 'Location' THEN CASE WHEN list_has_any(a, b) THEN 'exact_geo' WHEN (len(a) > 0) <> (len(b) > 0) THEN 'exact_geo_hint_partial' WHEN len(a) = 0 AND len(b) = 0 THEN 'exact' END
         WHEN 'People' THEN CASE WHEN an IS NULL OR an = bn THEN 'exact' END
         WHEN 'Institution' THEN CASE WHEN list_has_any(a, b) THEN 'exact_ror' WHEN (len(a) > 0) <> (len(b) > 0) THEN 'exact_ror_partial' WHEN an = bn THEN 'exact' WHEN an IS NULL THEN 'exact_institution_partial' END
         ELSE 'exact' END AS reason FROM p""",
    bare=True,
)(
    lambda b: (
        lambda k, none: b.table("part").select(
            k.alias("k"),
            resolve.safeguard(
                F.when(k % 4 == 0, "Location").when(k % 4 == 1, "People").when(k % 4 == 2, "Institution").otherwise("Other"),
                F.when(F.col("p_size") > 25, F.array(F.lit("china"))).otherwise(none),
                F.when(k % 3 == 0, F.array(F.lit("china"))).when(k % 3 == 1, F.array(F.lit("india"))).otherwise(none),
                F.when(F.col("p_size") % 2 == 0, F.col("p_type")),
                F.col("p_type"),
            ).alias("reason"),
        )
    )(F.col("p_partkey"), F.array().cast("array<string>"))
)
query(
    "llm_guardrails",
    """WITH r AS (SELECT o_orderkey AS ord, o_orderkey % 300 AS id, o_custkey % 40 - 1 AS d FROM orders), f AS (SELECT id, arg_min(d, ord) AS d FROM r WHERE id < 250 GROUP BY 1)
       SELECT id, CASE WHEN d BETWEEN 0 AND 24 THEN 'n' || d ELSE 'x' || id END AS canonical FROM f""",
    bare=True,
)(
    lambda b: resolve.guard_replies(
        b.table("orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 300).alias("id"), (F.col("o_custkey") % 40 - 1).alias("duplicate_idx")),
        b.spark.range(250).select("id", F.concat(F.lit("x"), "id").alias("uuid")),
        b.table("nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("n"), "n_nationkey").alias("uuid")),
    )
)
query(
    "dedupe_nodes_batch",
    LONG + """, hd AS (SELECT key, min(uuid) AS u FROM ks GROUP BY 1), f1 AS (SELECT e, min(uuid) AS u FROM nk GROUP BY 1),
       lk AS (SELECT ks.uuid AS a, hd.u AS b FROM ks JOIN hd ON ks.key = hd.key UNION SELECT x.u, y.u FROM pr JOIN f1 x ON x.e = pr.a JOIN f1 y ON y.e = pr.b WHERE score >= 0.9),
       bo AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), rc AS (SELECT uuid AS u, uuid AS x FROM nk UNION SELECT rc.u, bo.b FROM rc JOIN bo ON rc.x = bo.a)
       SELECT u AS uuid, min(x) AS canonical FROM rc GROUP BY 1""",
    bare=True,
)(lambda b: resolve.dedupe_batch(b.long_names().select("uuid", "name").unionByName(altered_names(b)), Lineage(b.spark)))
query(
    "name_match_fuzzy",
    r"""WITH nm AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct(list_transform(range(1, length(' ' || name || ' ') - 1), lambda i: substr(' ' || name || ' ', i, 3))) AS g FROM nm)
       SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS score FROM g a JOIN g b ON a.name < b.name AND list_has_any(a.g, b.g)
       WHERE len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) >= 0.5""",
    bare=True,
)(lambda b: resolve.alike_names(b.part_names(), 0.5).withColumn("score", r6(F.col("score"))))
query("clean_names", "SELECT c_custkey AS k, c_name AS name FROM customer", bare=True)(
    lambda b: b.table("customer").select(F.col("c_custkey").alias("k"), T.clean_name(F.concat(F.lit("​ "), "c_name", F.lit(" ﻿"))).alias("name")).where("name <> ''")
)

# ---- canonicalization -------------------------------------------------------------------------------------------

query("normalize_relation", "SELECT name, norm FROM ncn")(lambda b: b.name_counts().select("name", T.normalize_relation(F.col("name")).alias("norm")))
query("sanitize_label", r"""SELECT c_custkey AS k, regexp_replace(regexp_replace(regexp_replace(upper(c_name || ' (' || c_mktsegment || ')'), '[^A-Z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS label FROM customer""", bare=True)(
    lambda b: b.table("customer").select(F.col("c_custkey").alias("k"), T.sanitize_label(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("label"))
)
query(
    "extract_label",
    r"""WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '- "' || lower(c_mktsegment) || '"; because. More' WHEN 1 THEN '•* ' || c_mktsegment || chr(10) || 'x, y.' WHEN 2 THEN c_mktsegment || ', since' WHEN 3 THEN ' "' || chr(39) || lower(c_mktsegment) || chr(39) || '" '
         WHEN 4 THEN 'none of these' END AS r FROM customer),
       c AS (SELECT k, ltrim(CASE WHEN contains(r, chr(10)) THEN split_part(r, chr(10), 1) WHEN contains(r, '.') THEN split_part(r, '.', 1) WHEN contains(r, ';') THEN split_part(r, ';', 1) WHEN contains(r, ',') THEN split_part(r, ',', 1) ELSE coalesce(r, '') END, '-*• ') AS t FROM r),
       d AS (SELECT k, trim(trim(trim(trim(t), '"'), chr(39))) AS t FROM c)
       SELECT k, CASE WHEN lower(t) = 'building' THEN 'BUILDING' WHEN lower(t) = 'machinery' THEN 'MACHINERY' ELSE 'Any other' END AS label FROM d""",
    bare=True,
)(
    lambda b: (
        lambda k, seg: b.table("customer").select(
            k.alias("k"),
            T.extract_label(
                F.when(k % 6 == 0, F.concat(F.lit('- "'), F.lower(seg), F.lit('"; because. More')))
                .when(k % 6 == 1, F.concat(F.lit("•* "), seg, F.lit("\nx, y.")))
                .when(k % 6 == 2, F.concat(seg, F.lit(", since")))
                .when(k % 6 == 3, F.concat(F.lit(" \"'"), F.lower(seg), F.lit("'\" ")))
                .when(k % 6 == 4, "none of these"),
                ["BUILDING", "MACHINERY"],
                "Any other",
            ).alias("label"),
        )
    )(F.col("c_custkey"), F.col("c_mktsegment"))
)
query("lucene_query", r"""WITH t AS (SELECT item_id, regexp_replace(text, '([+\-&|!(){}\[\]^\"~*?:\\/ORNTAD])', '\\\1', 'g') AS q FROM benchmark)
       SELECT item_id, CASE WHEN len(string_split(q, ' ')) + 2 >= 40 THEN '' ELSE 'group_id:"g1" OR group_id:"g2" AND (' || q || ')' END AS query FROM t""", bare=True)(
    lambda b: b.table("benchmark").select("item_id", T.lucene_query(F.col("text"), ["g1", "g2"], 40).alias("query"))
)
query("embedding_text", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents", bare=True)(lambda b: b.table("documents").select("doc_id", T.embedding_text(F.col("text")).alias("text")))
query(
    "tfidf_candidates",
    """WITH nm AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, k, unnest(list_transform(range(1, length(name) - k + 2), lambda i: substr(name, i, k))) AS g FROM nm, (SELECT unnest([3, 4, 5]) AS k)),
       tf AS (SELECT name, g, count(*)::DOUBLE AS tf FROM g GROUP BY ALL), df AS (SELECT g, ln((1.0::DOUBLE + (SELECT count(*) FROM nm)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY 1),
       w AS (SELECT name, tf.g, tf * idf AS w FROM tf JOIN df ON tf.g = df.g), l AS (SELECT name, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), u AS (SELECT w.name, g, w / l AS w FROM w JOIN l ON w.name = l.name)
       SELECT a.name AS a, b.name AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.g = b.g AND a.name < b.name GROUP BY ALL HAVING sum(a.w * b.w) >= 0.3""",
    bare=True,
)(lambda b: canon.tfidf_pairs(b.part_names().select("name").distinct(), 0.3).withColumn("similarity", r6(F.col("similarity"))))
query("cluster_names")(lambda b: canon.cluster_names(b.table("embeddings").select(F.concat(F.lit("n"), F.lpad("vec_id", 7, "0")).alias("name"), "embedding"), "embedding", 0.6, Lineage(b.spark)))
query(
    "consolidate_clusters",
    """, cm AS (SELECT name AS cluster_id, name, n FROM nc), nr AS (SELECT cluster_id, norm, cm.n, row_number() OVER (PARTITION BY norm ORDER BY cm.n DESC, cluster_id) AS r FROM cm JOIN ncn ON ncn.name = cm.name)
       SELECT b.cluster_id, a.cluster_id AS name, a.n AS count FROM nr a JOIN nr b ON a.norm = b.norm AND b.r = 1""",
)(
    lambda b: canon.consolidate(b.name_counts().withColumn("cluster_id", F.col("name")), b.name_counts().select(F.col("name").alias("cluster_id"), F.col("name").alias("representative"), F.col("count").alias("total_count"))).select("cluster_id", "name", "count")
)
query(
    "compare_versions",
    """SELECT 'clusters' AS metric, (SELECT count(*) FROM nc)::DOUBLE AS before, (SELECT count(*) FROM sizes)::DOUBLE AS after, (SELECT count(*) FROM sizes)::DOUBLE - (SELECT count(*) FROM nc) AS delta,
       round(((SELECT count(*) FROM sizes)::DOUBLE - (SELECT count(*) FROM nc)) / (SELECT count(*) FROM nc) * 100, 6) AS percent""",
)(
    lambda b: report.compare(
        b.name_counts().agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("clusters").alias("metric"), "value"),
        canon.collapsed(b.mapping()).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("clusters").alias("metric"), "value"),
    ).withColumn("percent", r6(F.col("percent")))
)
query(
    "merge_review_pairs",
    GRAPH
    + """, e AS (SELECT label, list_transform(range(1, 65), lambda i: v[i] / sqrt(list_dot_product(v, v)) + 0.8::DOUBLE * q[i] / sqrt(list_dot_product(q, q))) AS x FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, q0)),
       m AS (SELECT label, i, avg(x[i]) AS x FROM (SELECT label, x, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY 1), u AS (SELECT m.label, i, x / (l + 1e-9) AS x FROM m JOIN l ON m.label = l.label)
       SELECT a, b, round(d, 6) AS distance FROM (SELECT a.label AS a, b.label AS b, 1 - sum(a.x * b.x) AS d FROM u a JOIN u b ON a.i = b.i AND a.label < b.label GROUP BY ALL) WHERE d <= 0.15 ORDER BY d, a, b LIMIT 200""",
    bare=True,
)(lambda b: canon.centroid_pairs(canon.centroids(b.close_vectors(0.8), "label", "embedding"), "label", 0.15, 200).withColumn("distance", r6(F.col("distance"))))
query("parse_reply", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'MERGE' ELSE 'KEEP' END AS decision, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '_OF' END AS label FROM customer", bare=True)(
    lambda b: b.table("customer").select(F.col("c_custkey").alias("k"), canon.parse_reply(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("merge | "), F.lower("c_mktsegment"), F.lit(" of"))).otherwise("KEEP")).alias("r")).select("k", "r.decision", "r.label")
)
query("sweep_stats", "SELECT k AS threshold, count(*) AS clusters, sum(n) AS edges, round(avg(n), 6) AS avg_edges, round(avg(m), 6) AS avg_names FROM (SELECT k, substr(replace(name, 'IS_', ''), 1, k) AS c, sum(n) AS n, count(*) AS m FROM nc, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL) GROUP BY 1")(
    lambda b: report.cluster_stats(
        b.name_counts().withColumn("threshold", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).groupBy("threshold", F.expr("substr(replace(name, 'IS_', ''), 1, threshold)").alias("c")).agg(F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("members")), ["threshold"]
    ).select("threshold", "clusters", "edges", r6(F.col("avg_edges")).alias("avg_edges"), r6(F.col("avg_names")).alias("avg_names"))
)

# ---- texts ------------------------------------------------------------------------------------------------------

query("chunk_documents")(lambda b: chunking.split_column(b.table("documents"), "doc_id", "text", chunking.split_recursive))
query("pack_paragraphs")(lambda b: chunking.split_column(b.table("documents"), "doc_id", "text", chunking.pack_paragraphs))
query(
    "fixed_chunks",
    "SELECT doc_id, i AS position, substr(text, i * 850 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 150) / 850.0)::BIGINT, 1))) AS i FROM documents WHERE length(text) > 0)",
    bare=True,
)(lambda b: chunking.fixed_chunks(b.table("documents"), "doc_id", "text"))
query("chunk_estimate", "SELECT doc_id, ceil(length(text) / 850.0)::BIGINT AS chunks FROM documents", bare=True)(lambda b: b.table("documents").select("doc_id", chunking.chunk_estimate(F.col("text")).alias("chunks")))
query("text_stats", r"SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '\s+', '', 'g')) AS solid, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS words FROM documents", bare=True)(
    lambda b: b.table("documents").select("doc_id", long(F.length("text")).alias("chars"), long(F.length(F.regexp_replace("text", r"\s+", ""))).alias("solid"), long(T.word_count(F.col("text"))).alias("words"))
)
query(
    "truncate_at_sentence",
    r"""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN regexp_extract(substr(text, 1, 500), '(?s)^(.*[.!?])(\s|$)', 1) <> '' THEN regexp_extract(substr(text, 1, 500), '(?s)^(.*[.!?])(\s|$)', 1) ELSE rtrim(substr(text, 1, 500)) END AS head FROM documents""",
    bare=True,
)(lambda b: b.table("documents").select("doc_id", T.truncate_at_sentence(F.col("text")).alias("head")))
query("clean_input", "SELECT doc_id, text FROM documents", bare=True)(lambda b: b.table("documents").select("doc_id", T.clean_input(F.concat(F.lit("​\u0007"), "text", F.lit("﻿"))).alias("text")))
query("chunk_label", "SELECT uuid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE uuid END AS label FROM (SELECT 'o' || o_orderkey AS uuid, o_orderkey FROM orders)", bare=True)(
    lambda b: b.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uuid"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("book-part_"), "o_orderkey")).otherwise("book").alias("n")).select("uuid", T.chunk_label(F.col("n"), F.col("uuid")).alias("label"))
)
query("format_secs", "SELECT o_orderkey AS k, printf('%02d:%02d:%02d', CAST(floor(o_totalprice) AS BIGINT) // 3600, CAST(floor(o_totalprice) AS BIGINT) % 3600 // 60, CAST(floor(o_totalprice) AS BIGINT) % 60) AS t FROM orders", bare=True)(
    lambda b: b.table("orders").select(F.col("o_orderkey").alias("k"), T.format_secs(F.col("o_totalprice")).alias("t"))
)
query("json_salvage", "SELECT event_id, props AS json FROM events", bare=True)(
    lambda b: b.table("events").select(
        "event_id",
        T.json_salvage(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("well "), "props", F.lit(" ok"))).otherwise(F.col("props"))).alias("json"),
    )
)
query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS s FROM embeddings", bare=True)(
    lambda b: b.table("embeddings").select("vec_id", r6(F.aggregate(V.l2_normalize(V.doubles(F.col("embedding"))), F.lit(0.0), lambda s, x: s + x)).alias("s"))
)
query("compose_query_from_messages", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS query FROM conversations GROUP BY 1", bare=True)(
    lambda b: b.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("m")))), lambda x: x["m"]), "\n").alias("query"))
)
query("escape_tsv", r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS cell FROM documents", bare=True)(
    lambda b: b.table("documents").select("doc_id", T.escape_tsv(F.col("text")).alias("cell"))
)


# ---- one query for each recipe ----------------------------------------------------------------------------------


def lists_sql(rows: str, text: str, terms: list[str], p: str = "", vector: bool = True, more: str = "") -> str:
    """SQL for the lists (uuid, m, r) that a recipe's methods give, as {p}l, and their fusion, as {p}f."""
    found = bm25_sql(rows, text, terms)
    for name in ("tk", "tfs", "st", "bm"):
        found = found.replace(f"{name} AS (", f"{p}{name} AS (").replace(f"FROM {name}", f"FROM {p}{name}").replace(f", {name} WHERE", f", {p}{name} WHERE")
    near = f" UNION ALL SELECT uuid, 1, row_number() OVER (ORDER BY list_cosine_similarity(v, q) DESC, uuid) - 1 FROM {rows}, q0 WHERE (1 + list_cosine_similarity(v, q)) / 2 > 0.6" if vector else ""
    return f"""{found}, {p}h AS (SELECT uuid, m, r FROM (SELECT uuid, 0 AS m, row_number() OVER (ORDER BY score DESC, uuid) - 1 AS r FROM {p}bm{near}) WHERE r < 20){more},
      {p}l AS (SELECT * FROM {p}h{f" UNION ALL SELECT uuid, 2, r FROM {p}reach WHERE r < 20" if more else ""}), {p}f AS (SELECT uuid, sum(1 / (r + 1)::DOUBLE) AS score, min((m, r)) AS seen FROM {p}l GROUP BY 1)"""


def mmr_sql(rows: str) -> str:
    return f""", c AS (SELECT uuid, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM {rows} WHERE uuid IN (SELECT uuid FROM f)),
       k AS (SELECT a.uuid, coalesce(greatest(0, max(list_dot_product(a.v, b.v))), 0) AS m FROM c a LEFT JOIN c b ON a.uuid <> b.uuid GROUP BY 1),
       z AS (SELECT c.uuid, 0.5::DOUBLE * list_dot_product(v, q) - 0.5::DOUBLE * m AS score FROM c JOIN k ON c.uuid = k.uuid, q0)
       SELECT uuid, round(score, 6) AS score FROM z WHERE score >= 0 ORDER BY z.score DESC, uuid LIMIT 10"""


def crossed_sql(rows: str, text: str, words: list[str], among: str = "f") -> str:
    held = f"len(list_intersect({words}, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')))::DOUBLE / {len(words)}"
    return f""", d AS (SELECT {text} AS t, max(uuid) AS uuid FROM {rows} WHERE uuid IN (SELECT uuid FROM {among}) GROUP BY 1) SELECT uuid, {held} AS score FROM d ORDER BY {held} DESC, uuid LIMIT 10"""


FUSED = " SELECT uuid, round(score, 6) AS score FROM f ORDER BY f.score DESC, seen LIMIT 10"
CUST = """, lnk AS (SELECT 'c' || o_custkey AS s, 'c' || ((o_custkey * 3 + o_orderkey) % 1500) AS t, o_orderstatus AS status FROM orders), lcomm AS (SELECT 'l' || label AS uuid, 'brand ' || label AS name, list(x ORDER BY i) AS v
  FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)"""
NEAR_C1 = ", near AS (SELECT t AS u FROM lnk WHERE s = 'c1' UNION SELECT s FROM lnk WHERE t = 'c1')"
EDGES, NODES, COMMS = ("vedge", "fact", ["about", "3"]), ("vnode", "name || ' ' || summary", ["household", "building"]), ("lcomm", "name", ["brand", "7"])
#: Facts of the sources found; no fact of theirs leads to a source, so the first hop is the last.
EDGE_REACH = ", reach AS (SELECT uuid, row_number() OVER (ORDER BY uuid) - 1 AS r FROM vedge WHERE s IN (SELECT s FROM vedge WHERE uuid IN (SELECT uuid FROM h)))"
#: Nodes on paths from those found, of the group of the node the path comes from.
NODE_REACH = """, walk AS (SELECT t AS u, group_id AS g, 1 AS hop FROM lnk JOIN vnode ON s = uuid WHERE s IN (SELECT uuid FROM h) UNION SELECT lnk.t, g, hop + 1 FROM walk JOIN lnk ON s = u WHERE hop < 3),
  reach AS (SELECT uuid, row_number() OVER (ORDER BY min(hop), uuid) - 1 AS r FROM walk JOIN vnode ON uuid = u AND group_id = g GROUP BY uuid)"""


def by_recipe(b: Bound, name: str, combined: str | None = None) -> DataFrame:
    """The scope that a preset of one scope names, by its recipe or by that of a combined preset for this scope."""
    recipe = search.RECIPES[name]
    if combined:
        recipe = replace(recipe, **{k: getattr(search.RECIPES[combined], k) for k in ("edges", "nodes", "communities") if getattr(recipe, k)})
    if recipe.edges:
        return scored(search.hybrid(b.vector_edges(), "about 3", b.query_vector(), ["fact"], "embedding", recipe.edges, "edges", search.Surroundings(center="c1")))
    if recipe.nodes:
        mentions = b.links("P").select("target_node_uuid")
        return scored(search.hybrid(b.vector_nodes(), "household building", b.query_vector(), ["name", "summary"], "embedding", recipe.nodes, "nodes", search.Surroundings(b.links(), mentions, "c1")))
    return scored(search.hybrid(b.label_communities(), "brand 7", b.query_vector(), ["name"], "embedding", recipe.communities, "communities"))


RECIPE_SQL = {
    "edges_rrf": lists_sql(*EDGES) + FUSED,
    "edges_mmr": lists_sql(*EDGES) + mmr_sql("vedge"),
    "edges_cross_encoder": lists_sql(*EDGES, more=EDGE_REACH) + ", few AS (SELECT uuid FROM f ORDER BY seen LIMIT 10)" + crossed_sql("vedge", "fact", EDGES[2], "few"),
    "edges_node_distance": lists_sql(*EDGES)
    + """, z AS (SELECT f.uuid, CASE WHEN s = 'c1' THEN 10 ELSE 0 END::DOUBLE AS score, min((-f.score, seen)) OVER (PARTITION BY s) AS head, (-f.score, seen) AS own FROM f JOIN vedge ON f.uuid = vedge.uuid)
       SELECT uuid, score FROM z ORDER BY z.score DESC, head, own LIMIT 10""",
    "edges_episode_mentions": lists_sql(*EDGES) + " SELECT f.uuid, round(f.score, 6) AS score FROM f JOIN vedge ON f.uuid = vedge.uuid ORDER BY neps DESC, f.score DESC, seen LIMIT 10",
    "nodes_rrf": lists_sql(*NODES) + FUSED,
    "nodes_mmr": lists_sql(*NODES) + mmr_sql("vnode"),
    "nodes_cross_encoder": CUST + lists_sql(*NODES, more=NODE_REACH) + crossed_sql("vnode", "name", NODES[2]),
    "nodes_node_distance": CUST + NEAR_C1 + lists_sql(*NODES)
    + " SELECT uuid, CASE WHEN uuid = 'c1' THEN 10 WHEN uuid IN (SELECT u FROM near) THEN 1 ELSE 0 END::DOUBLE AS score FROM f ORDER BY 2 DESC, f.score DESC, seen LIMIT 10",
    "nodes_episode_mentions": CUST + lists_sql(*NODES)
    + """, mc AS (SELECT t, count(*)::DOUBLE AS n FROM lnk WHERE status = 'P' GROUP BY 1), z AS (SELECT uuid, coalesce(n, 'Infinity'::DOUBLE) AS n, f.score AS fs, seen FROM f LEFT JOIN mc ON t = uuid)
       SELECT uuid, n AS score FROM z ORDER BY n, fs DESC, seen LIMIT 10""",
    "communities_rrf": CUST + lists_sql(*COMMS) + FUSED,
    "communities_mmr": CUST + lists_sql(*COMMS) + mmr_sql("lcomm"),
    "communities_cross_encoder": CUST + lists_sql(*COMMS) + crossed_sql("lcomm", "name", COMMS[2]),
}
for preset, preset_sql in RECIPE_SQL.items():
    query(f"recipe_{preset}", preset_sql)(lambda b, preset=preset: by_recipe(b, preset))
for preset in ("edges", "nodes", "communities"):
    query(f"combined_cross_encoder_{preset}", RECIPE_SQL[f"{preset}_cross_encoder"])(lambda b, preset=preset: by_recipe(b, f"{preset}_cross_encoder", "combined_cross_encoder"))
    query(f"combined_mmr_{preset}", RECIPE_SQL[f"{preset}_mmr"].replace("0.5::DOUBLE * list_dot_product(v, q) - 0.5::DOUBLE * m", "list_dot_product(v, q)"))(lambda b, preset=preset: by_recipe(b, f"{preset}_mmr", "combined_mmr"))
query("combined_cross_encoder_episodes", lists_sql("msg", "content", ["the", "und"], vector=False) + crossed_sql("msg", "content", ["the", "und"]))(
    lambda b: scored(search.hybrid(b.messages(), "the und", None, ["content"], None, search.RECIPES["combined_cross_encoder"].episodes, "episodes"))
)
query("episode_mentions_edges", RECIPE_SQL["edges_episode_mentions"])(lambda b: by_recipe(b, "edges_episode_mentions"))

COMBINED = [("edge", EDGES, True), ("node", NODES, True), ("episode", ("msg", "content", ["the", "und"]), False), ("community", ("comm", "name", ["brand", "7"]), False)]
query(
    "search_combined",
    "".join(lists_sql(*what, p=f"x{i}_", vector=vector) for i, (_, what, vector) in enumerate(COMBINED))
    + " UNION ALL ".join(f" (SELECT '{scope}' AS scope, uuid, round(score, 6) AS score FROM x{i}_f ORDER BY x{i}_f.score DESC, seen LIMIT 10)" for i, (scope, _, _) in enumerate(COMBINED)),
)(
    lambda b: (
        lambda r: scored(search.hybrid(b.vector_edges(), "about 3", b.query_vector(), ["fact"], "embedding", r.edges, "edges")).withColumn("scope", F.lit("edge"))
        .unionByName(scored(search.hybrid(b.vector_nodes(), "household building", b.query_vector(), ["name", "summary"], "embedding", r.nodes)).withColumn("scope", F.lit("node")))
        .unionByName(scored(search.hybrid(b.messages(), "the und", None, ["content"], None, r.episodes, "episodes")).withColumn("scope", F.lit("episode")))
        .unionByName(scored(search.hybrid(b.communities(), "brand 7", None, ["name"], None, r.communities, "communities")).withColumn("scope", F.lit("community")))
    )(search.RECIPES["combined_rrf"])
)
query(
    "search_merged",
    lists_sql(*EDGES, p="a_") + lists_sql("vedge", "fact", ["about", "4"], p="b_")
    + " (SELECT uuid, round(score, 6) AS score FROM a_f ORDER BY a_f.score DESC, seen LIMIT 10) UNION ALL (SELECT uuid, round(score, 6) AS score FROM b_f ORDER BY b_f.score DESC, seen LIMIT 10)",
)(
    lambda b: scored(
        search.merged([{"edges": search.hybrid(b.vector_edges(), q, b.query_vector(), ["fact"], "embedding", search.RECIPES["edges_rrf"].edges, "edges")} for q in ("about 3", "about 4")])["edges"]
    )
)
query(
    "relevant_nodes_fused",
    r""", tk AS (SELECT uuid, group_id, v, list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM vnode), sz AS (SELECT group_id, count(*)::DOUBLE AS n, avg(len(w)::DOUBLE) AS avgdl FROM tk GROUP BY 1),
       ps AS (SELECT uuid, group_id, len(w)::DOUBLE AS dl, t, count(*)::DOUBLE AS tf FROM (SELECT *, unnest(w) AS t FROM tk) GROUP BY ALL), df AS (SELECT group_id, t, count(*)::DOUBLE AS df FROM ps GROUP BY ALL),
       qs AS (SELECT DISTINCT uuid AS q, group_id, t FROM ps), tx AS (SELECT q, p.uuid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
         FROM qs JOIN ps p ON p.group_id = qs.group_id AND p.t = qs.t AND p.uuid <> q JOIN df ON df.group_id = qs.group_id AND df.t = qs.t JOIN sz ON sz.group_id = qs.group_id GROUP BY ALL),
       vx AS (SELECT a.uuid AS q, b.uuid, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS score FROM vnode a JOIN vnode b ON a.group_id = b.group_id AND a.uuid <> b.uuid WHERE (1 + list_cosine_similarity(a.v, b.v)) / 2 > 0.6),
       al AS (SELECT q, uuid, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, uuid) AS r FROM tx UNION ALL SELECT q, uuid, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, uuid) FROM vx)
       SELECT q AS query_uuid, uuid, round(sum(1 / r::DOUBLE), 6) AS score FROM al WHERE r <= 5 GROUP BY ALL""",
)(lambda b: search.relevant_nodes(b.vector_nodes(), b.vector_nodes(), "embedding", limit=5, text="name").withColumn("score", r6(F.col("score"))))


query(
    "member_links",
    """, m AS (SELECT s, t FROM memb UNION ALL SELECT 'k' || n_nationkey, c.uuid FROM nation JOIN comm c ON TRUE UNION ALL SELECT 'nobody', t FROM memb)
       SELECT s || '>' || t AS uuid, 'Entity' AS kind FROM m WHERE s IN (SELECT uuid FROM comm) AND t IN (SELECT uuid FROM ent) UNION SELECT s || '>' || t, 'Community' FROM m WHERE s IN (SELECT uuid FROM comm) AND t IN (SELECT uuid FROM comm)""",
)(
    lambda b: (
        lambda m, c: graph.member_links(
            m.unionByName(b.table("nation").select(F.concat(F.lit("k"), "n_nationkey").alias("source_node_uuid")).join(F.broadcast(c.select(F.col("uuid").alias("target_node_uuid"))), F.lit(True)))  # 25 nations, as many brands
            .unionByName(m.select(F.lit("nobody").alias("source_node_uuid"), "target_node_uuid")).withColumn("uuid", F.concat("source_node_uuid", F.lit(">"), "target_node_uuid")),
            b.entities(), c,
        )
    )(b.members(), b.communities())
)


def counted_letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedder: how often each vowel stands in a text."""
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


def embedded_twice(b: Bound) -> DataFrame:
    """Names of parts, then of all entities, by way of one cache: the second time parts are known."""
    cache = EmbeddingCache(b.spark, f"{Lineage(b.spark).path}/vectors", "vowels", counted_letters)
    cache.embedded(b.part_names(), "name", "embedding").count()
    return cache.embedded(b.entities().select("uuid", "name"), "name", "embedding")


query("embed_names", "SELECT uuid, name, array_to_string(list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: length(name) - length(replace(name, c, ''))), ',') AS embedding FROM ent")(
    lambda b: embedded_twice(b).select("uuid", "name", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))
)

# ---- ingestion --------------------------------------------------------------------------------------------------


def ingested(b: Bound) -> TemporalGraph:
    """All orders as episodes in two batches and two groups: customers (by names that are not alike) and parts as nodes of
    each batch's own uuids, lines as facts. A fact of another state of the same customer and part contradicts it, says the judge."""
    graph_, stamp = TemporalGraph(b.spark, f"{Lineage(b.spark).path}/graph"), F.col("o_orderdate").cast("timestamp")
    orders = b.table("orders").select("o_orderkey", "o_custkey", stamp.alias("at"), (F.col("o_orderkey") % 2).alias("batch"), F.concat(F.lit("g"), F.col("o_custkey") % 2).alias("group_id"))
    lines = b.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(b.table("customer").select("c_custkey", F.md5(F.encode("c_name", "utf-8")).alias("c_name")), F.col("o_custkey") == F.col("c_custkey")).join(b.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = Lineage(b.spark).cut(rows)  # both batches read it, for nodes and for facts
    own = lambda letter, key: F.concat("group_id", F.lit(f"_{letter}"), key, F.lit("_"), "batch")

    def extract(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        ends = [rows.select(own(c, k).alias("uuid"), F.col(n).alias("name"), "group_id", F.array(F.lit(label)).alias("labels")).distinct() for c, k, n, label in (("c", "o_custkey", "c_name", "Customer"), ("p", "l_partkey", "p_name", "Part"))]
        facts = rows.select(
            F.concat(F.lit("e"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey").alias("uuid"), own("c", "o_custkey").alias("source_node_uuid"), own("p", "l_partkey").alias("target_node_uuid"), F.lit("ORDERED").alias("name"),
            F.concat("c_name", F.lit(" ordered "), "p_name", F.lit(" "), "flag").alias("fact"), "group_id", F.array(F.concat(F.lit("o"), "l_orderkey")).alias("episodes"), F.col("at").alias("created_at"), F.col("at").alias("valid_at"),
        )
        return ends[0].unionByName(ends[1]), facts

    what = lambda c: F.expr(f"substr({c}, 1, length({c}) - 2)")
    judge = Judge(contradicts=lambda pairs: pairs.where((what("fact") == what("new_fact")) & (F.col("fact") != F.col("new_fact"))).select("new_uuid", "uuid"), both_ends=True)
    for batch in (0, 1):
        episodes = orders.where(F.col("batch") == batch).select(F.concat(F.lit("o"), "o_orderkey").alias("uuid"), F.lit("order").alias("name"), "group_id", F.col("at").alias("created_at"), F.col("at").alias("valid_at"))
        graph_.add_episodes(episodes, lambda _, batch=batch: extract(rows.where(F.col("batch") == batch)), "2025-01-01", judge=judge)
    return graph_


def stated(graph_: TemporalGraph) -> DataFrame:
    name = lambda end: graph_.table("entities").select(F.col("uuid").alias(f"{end}_node_uuid"), F.col("name").alias(end), F.col("group_id").alias(f"{end}_group"))
    rows = graph_.table("edges").join(name("source"), "source_node_uuid").join(name("target"), "target_node_uuid")
    return rows.select(
        "uuid", "group_id", "source", "source_group", "target", "target_group", "fact", day("valid_at").alias("valid_at"), day("invalid_at").alias("invalid_at"), F.col("expired_at").isNotNull().alias("expired"),
        joined(F.array_sort("episodes")).alias("episodes"), F.element_at("episodes", 1).alias("first_episode"),
    )


INGESTED = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
  r AS (SELECT 'e' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS uuid, o_orderkey % 2 AS batch, 'g' || (o_custkey % 2) AS g, o_custkey, l_partkey, md5(c_name) AS s, p_name AS t, md5(c_name) || ' ordered ' || p_name || ' ' || flag AS fact, o_orderdate AS vt, 'o' || l_orderkey AS ep
    FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
  f AS (SELECT batch, g, s, t, fact, min((vt, uuid)) AS head, min(vt) AS vt, arg_min(ep, (vt, uuid)) AS ep, list(DISTINCT ep) AS eps FROM r GROUP BY ALL),
  old AS (SELECT *, head[2] AS uuid FROM f WHERE batch = 0), new AS (SELECT *, head[2] AS uuid FROM f WHERE batch = 1),
  fresh AS (SELECT n.* FROM new n ANTI JOIN old o ON o.g = n.g AND o.s = n.s AND o.t = n.t AND o.fact = n.fact),
  late AS (SELECT n.uuid, min(o.vt) AS nxt FROM fresh n JOIN old o ON o.g = n.g AND o.s = n.s AND o.t = n.t AND o.fact <> n.fact AND o.vt > n.vt GROUP BY 1),
  over AS (SELECT o.uuid, min(n.vt) AS nxt FROM fresh n JOIN old o ON o.g = n.g AND o.s = n.s AND o.t = n.t AND o.fact <> n.fact AND o.vt < n.vt GROUP BY 1),
  a AS (SELECT o.uuid, o.g, o.s, o.t, o.fact, o.vt, nxt, list_distinct(list_concat(o.eps, coalesce(n.eps, []))) AS eps, o.ep FROM old o LEFT JOIN new n ON o.g = n.g AND o.s = n.s AND o.t = n.t AND o.fact = n.fact LEFT JOIN over ON over.uuid = o.uuid
    UNION ALL SELECT n.uuid, n.g, n.s, n.t, n.fact, n.vt, nxt, n.eps, n.ep FROM fresh n LEFT JOIN late ON late.uuid = n.uuid)"""
query(
    "ingest_episodes",
    INGESTED + """, n AS (SELECT DISTINCT batch, g, g || '_c' || o_custkey || '_' || batch AS uuid, s AS name FROM r UNION SELECT DISTINCT batch, g, g || '_p' || l_partkey || '_' || batch, t FROM r)
       SELECT uuid, g AS group_id, s AS source, g AS source_group, t AS target, g AS target_group, fact, strftime(vt, '%Y-%m-%d') AS valid_at, strftime(nxt, '%Y-%m-%d') AS invalid_at, nxt IS NOT NULL AS expired, array_to_string(list_sort(eps), ',') AS episodes, ep AS first_episode FROM a
       UNION ALL SELECT arg_min(uuid, (batch, uuid)), g, arg_min(name, (batch, uuid)), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM n GROUP BY g, lower(name)""",
    bare=True,
)(lambda b: (lambda g: stated(g).unionByName(g.table("entities").select("uuid", "group_id", F.col("name").alias("source")), allowMissingColumns=True))(ingested(b)))
