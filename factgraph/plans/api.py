"""The graph as a whole: tables in versions, ingestion, search, maintenance, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factgraph import schema
from factgraph.functions import text as T
from factgraph.functions import vectors as V
from factgraph.operators import filters, graph, resolve, store, temporal
from factgraph.operators import search as retrieval
from factgraph.plans.index import TextIndex
from factgraph.plans.lineage import Lineage
from factgraph.plans.versions import BUCKETS, Change, Versions

#: episodes -> (entities, edges): a model's extraction, with uuids of its own.
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Judge:
    """What a model decides during ingestion, each a callable from a DataFrame to its reply; without one nothing is decided.

    ``contradicts`` gets pairs(new_uuid, new_fact, new_valid_at, uuid, fact, valid_at) of new facts and those of the
    graph that share an end with them and gives back the pairs(new_uuid, uuid) in which the new fact contradicts the other;
    with ``both_ends`` it gets only those of the same two ends, which spares all pairs of the facts of a hub.
    ``same`` gets questions(id, name, candidates: idx, uuid, name), the nodes that rules could not resolve and the likely
    nodes of their group, and gives back replies(ord, id, duplicate_idx), of which unknown and repeated ids, and indices
    that no candidate has, are ignored. ``dates`` gets the new facts and gives back dates(uuid, valid_at, invalid_at).
    """

    contradicts: Callable[[DataFrame], DataFrame] | None = None
    same: Callable[[DataFrame], DataFrame] | None = None
    dates: Callable[[DataFrame], DataFrame] | None = None
    both_ends: bool = False


@dataclass(frozen=True)
class Ingested:
    """pointers(uuid, canonical) of the nodes that were found, and duplicates(source_node_uuid, target_node_uuid), those
    of them that no IS_DUPLICATE_OF edge of the graph says yet."""

    pointers: DataFrame
    duplicates: DataFrame


class TemporalGraph:
    """Graph tables below ``path``. A change of one table or several becomes visible at once or not at all, and writes
    the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/tables", schema.TABLES, buckets)
        self._open: Change | None = None

    # ---- tables

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is now, within a change as that leaves it, or as of a version."""
        return self._open.table(name) if self._open and version is None else self.versions.table(name, version)

    def change(self, work: Callable[[], object], mark: tuple[str, int] | None = None) -> object:
        """All that work changes as one commit; work runs again where another writer has changed what it read."""
        if self._open:
            return work()

        def run(change: Change) -> object:
            self._open = change
            try:
                return work()
            finally:
                self._open = None

        return self.versions.change(run, mark)

    def replace(self, name: str, df: DataFrame) -> None:
        self.change(lambda: self._open.replace(name, df))

    def delete(self, name: str, ids: DataFrame) -> None:
        """Remove rows of ids(uuid)."""
        self.change(lambda: self._open.delete(name, ids))

    def upsert(self, name: str, rows: DataFrame) -> None:
        def work() -> None:
            fitted = store.with_label(rows) if name == "entities" else store.with_ends(rows, self.table("entities")) if name == "edges" else rows
            self._open.upsert(name, fitted)

        self.change(work)

    # ---- episodes

    def retrieve_episodes(self, reference_time: str, last_n: int = 3, groups: list[str] | None = None, source: str | None = None) -> DataFrame:
        rows = self.table("episodes").where(filters.in_groups(F.col("group_id"), groups))
        return temporal.retrieve_episodes(rows, reference_time, last_n, source=source)

    def add_episodes(
        self,
        episodes: DataFrame,
        extract: Extractor,
        now: str,
        type_map: DataFrame | None = None,
        custom_types: list[str] | None = None,
        judge: Judge = Judge(),
        institutions: DataFrame | None = None,
        mark: tuple[str, int] | None = None,
        excluded_types: list[str] | None = None,
    ) -> Ingested | None:
        """Save episodes with what the extractor finds, as one commit; None if ``mark`` says that it is in already.

        Entities are resolved against each other and the graph, within their group; institutions(name, ror_id) gives
        institutions the ids by which they may be told apart. Names of custom edge types are kept only where
        type_map(src_label, dst_label, edge_type) allows them; edges are repointed. A fact that stands in the graph word
        for word is not written again: its episodes go to the one that stands. Nodes of ``excluded_types`` and facts that
        end at them are left out, and attributes lose keys that are columns of their table or name embeddings. Facts that the judge says new ones
        contradict are ended; new facts that are over already, by their own end or because they contradict a later one,
        are written as expired. Group, ends and wording tell facts apart; no fact ends for its wording alone.
        """
        lineage = Lineage(self.spark)
        episodes = lineage.cut(episodes)
        nodes, edges = filters.without_excluded(*extract(episodes), excluded_types or [])
        nodes, edges = (self._own_attributes(df, name) for df, name in ((nodes, "entities"), (edges, "edges")))
        nodes, edges = lineage.cut(filters.named(nodes)), lineage.cut(edges)

        def work() -> Ingested:
            self.upsert("episodes", episodes)
            pointers = self._resolved(nodes, lineage, judge, institutions)
            facts = lineage.cut(graph.repoint(edges.where(F.trim("fact") != ""), pointers))
            self._add_facts(facts, now, lineage, judge, type_map, custom_types or [])
            found = pointers.select(F.col("canonical").alias("target_node_uuid")).distinct()
            seen = episodes.select(F.col("uuid").alias("source_node_uuid"), "group_id", "created_at")
            rows = self._mentions(facts).join(seen, "source_node_uuid").join(found, "target_node_uuid", "left_semi")
            self.upsert("mentions", rows.withColumn("uuid", F.concat(F.lit("me_"), "source_node_uuid", F.lit("_"), "target_node_uuid")))
            pairs = pointers.where("uuid <> canonical").select(F.col("uuid").alias("source_node_uuid"), F.col("canonical").alias("target_node_uuid"))
            return Ingested(pointers, resolve.without_known_duplicates(pairs, self.table("edges")))

        return self.change(work, mark)

    @staticmethod
    def _own_attributes(df: DataFrame, name: str) -> DataFrame:
        columns = StructType.fromDDL(schema.TABLES[name]).names
        return df.withColumn("attributes", filters.strip_attribute_text(F.col("attributes"), columns)) if "attributes" in df.columns else df

    def add_triplet(self, source: DataFrame, edge: DataFrame, target: DataFrame, now: str, judge: Judge = Judge()) -> None:
        """Save one fact with its ends: rows of entities, edges and entities. Ends that the graph knows are taken from it,
        and the fact is reused, expired or ends others as in an episode; no episode states it but those it names."""
        lineage = Lineage(self.spark)
        nodes = lineage.cut(filters.named(source.unionByName(target, allowMissingColumns=True)))
        edge = lineage.cut(edge if "episodes" in edge.columns else edge.withColumn("episodes", F.array().cast("array<string>")))
        self.change(lambda: self._add_facts(lineage.cut(graph.repoint(edge, self._resolved(nodes, lineage, judge))), now, lineage, judge))

    def _resolved(self, nodes: DataFrame, lineage: Lineage, judge: Judge = Judge(), institutions: DataFrame | None = None) -> DataFrame:
        """(uuid, canonical) of nodes, new ones of which are saved. Groups are apart."""
        order = "ord" if "ord" in nodes.columns else None
        inside = lineage.cut(resolve.dedupe_batch(nodes, lineage, by="group_id", order=order))
        heads = nodes.join(inside.where("uuid = canonical").select("uuid"), "uuid", "left_semi")
        there = self.table("entities")
        if there.isEmpty():  # nothing to be found in
            known = self.spark.createDataFrame([], "uuid string, canonical string, reason string")
        else:
            known = lineage.cut(resolve.resolve(self._guarded(heads, institutions), self._guarded(there, institutions), by="group_id"))
        if judge.same and not there.isEmpty():
            asked = lineage.cut(self._questions(heads.join(known.select("uuid"), "uuid", "left_anti"), there))
            choices = asked.select("id", F.inline("candidates"))
            replies = resolve.guard_replies(judge.same(asked), asked.select("id", F.col("id").alias("uuid")), choices.select("id", "idx", "uuid"))
            told = replies.where("id <> canonical").select(F.col("id").alias("uuid"), "canonical", F.lit("reply").alias("reason"))
            known = lineage.cut(known.unionByName(told))
        ahead = known.select(F.col("uuid").alias("__u"), F.col("canonical").alias("__c"))
        pointers = lineage.cut(inside.join(ahead, inside.canonical == F.col("__u"), "left").select("uuid", F.coalesce("__c", "canonical").alias("canonical")))
        self.upsert("entities", heads.join(known.select("uuid"), "uuid", "left_anti"))
        return pointers

    @staticmethod
    def _questions(nodes: DataFrame, there: DataFrame) -> DataFrame:
        """questions(id, name, candidates) of nodes: by full text of the name, and by vectors where nodes have them, the
        likeliest nodes of the group, from 0."""
        found = retrieval.relevant_nodes(nodes, there, "name_embedding" if "name_embedding" in nodes.columns else None, text="name")
        place = F.struct((-F.col("score")).alias("s"), F.col("uuid").alias("uuid"), F.col("name").alias("name"))
        lists = found.join(there.select("uuid", "name"), "uuid").groupBy(F.col("query_uuid").alias("id")).agg(F.array_sort(F.collect_list(place)).alias("l"))  # at most twice the limit each
        numbered = F.transform("l", lambda x, i: F.struct(i.alias("idx"), x["uuid"].alias("uuid"), x["name"].alias("name")))
        return nodes.select(F.col("uuid").alias("id"), "name").join(lists.select("id", numbered.alias("candidates")), "id")

    @staticmethod
    def _guarded(nodes: DataFrame, institutions: DataFrame | None = None) -> DataFrame:
        """uuid, name, group_id and what the safeguards read: the kind by label, hints of places and institutions, the name
        a person or an institution gives."""
        has = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
        labels = F.col("labels") if "labels" in nodes.columns else F.array().cast("array<string>")
        kind = F.when(F.array_contains(labels, "Location"), "Location").when(F.array_contains(labels, "People"), "People").when(F.array_contains(labels, "Institution"), "Institution")
        own = F.lower(F.coalesce(F.get_json_object(has("attributes"), "$.person_name"), F.get_json_object(has("attributes"), "$.institution_name")))
        rows = nodes.select("uuid", "name", has("group_id").alias("group_id"), F.coalesce(kind, F.lit("Entity")).alias("kind"), resolve.geo_hints(has("summary"), has("attributes")).alias("places"), own.alias("own"))
        known = resolve.ror_hints(rows, institutions)
        hints = F.when(F.col("kind") == "Location", F.col("places")).when(F.col("kind") == "Institution", F.col("hints")).otherwise(F.array().cast("array<string>"))
        return known.select("uuid", "name", "group_id", "kind", hints.alias("hints"), "own")

    def _add_facts(self, facts: DataFrame, now: str, lineage: Lineage, judge: Judge = Judge(), type_map: DataFrame | None = None, custom_types: list[str] | None = None) -> None:
        if type_map is not None:
            names = resolve.allowed_edge_types(facts.select("uuid", "source_node_uuid", "target_node_uuid", "name"), self.table("entities"), type_map, custom_types or [])
            facts = facts.drop("name").join(names, "uuid")
        for column, kind in (("group_id", "string"), ("valid_at", "timestamp"), ("invalid_at", "timestamp"), ("expired_at", "timestamp")):
            facts = facts if column in facts.columns else facts.withColumn(column, F.lit(None).cast(kind))
        facts = lineage.cut(temporal.first_of_each(facts, T.norm_exact(F.col("fact")), "group_id"))
        old = self.table("edges")
        again = lineage.cut(temporal.reuse_verbatim(facts, old, T.norm_exact, "group_id").where("reused is not null"))
        new = facts.join(again.select("uuid"), "uuid", "left_anti")
        new = lineage.cut(temporal.enriched_dates(new, judge.dates(new)) if judge.dates else new)
        told = lineage.cut(self._contradicted(new, old, judge))
        later = told.join(old.select("uuid", "valid_at"), "uuid").select("new_uuid", "valid_at")
        new = lineage.cut(temporal.expire_new(new, later, now).select(*new.columns))
        hit = lineage.cut(self._ends(old, new, told, now))
        changed = again.select(F.col("reused").alias("uuid")).union(hit.select("__u")).distinct()
        rows = temporal.with_reused_episodes(old.join(changed, "uuid", "left_semi"), again)
        rows = rows.join(hit, rows.uuid == F.col("__u"), "left")
        rows = rows.withColumn("invalid_at", F.coalesce("__i", "invalid_at")).withColumn("expired_at", F.coalesce("__x", "expired_at")).drop("__u", "__i", "__x")
        self._open.upsert("edges", rows.unionByName(store.with_ends(new, self.table("entities")), allowMissingColumns=True))

    @staticmethod
    def _contradicted(new: DataFrame, old: DataFrame, judge: Judge) -> DataFrame:
        """(new_uuid, uuid) as the judge says, of facts of one group that share an end, or both."""
        if not judge.contradicts:
            return new.select(F.col("uuid").alias("new_uuid"), "uuid").limit(0)
        met = graph.edges_between if judge.both_ends else graph.edges_touching
        pairs = met(new.withColumn("group_id", F.coalesce("group_id", F.lit(""))), old.withColumn("group_id", F.coalesce("group_id", F.lit(""))))
        asked = new.select(F.col("uuid").alias("new_uuid"), F.col("fact").alias("new_fact"), F.col("valid_at").alias("new_valid_at"))
        pairs = pairs.withColumnRenamed("query_uuid", "new_uuid").join(asked, "new_uuid").join(old.select("uuid", "fact", "valid_at"), "uuid")
        told = judge.contradicts(pairs.select("new_uuid", "new_fact", "new_valid_at", "uuid", "fact", "valid_at")).select("new_uuid", "uuid").distinct()
        return told.join(pairs.select("new_uuid", "uuid"), ["new_uuid", "uuid"], "left_semi")

    @staticmethod
    def _ends(old: DataFrame, new: DataFrame, told: DataFrame, now: str) -> DataFrame:
        """(__u, __i, __x): facts of the graph that end because a new one contradicts them, and the ends they get."""
        e = old.select(F.col("uuid"), *(F.col(c).alias(f"e_{c}") for c in ("valid_at", "invalid_at", "expired_at")))
        n = new.select(F.col("uuid").alias("new_uuid"), *(F.col(c).alias(f"n_{c}") for c in ("valid_at", "invalid_at")))
        hit = temporal.contradicted(told.join(e, "uuid").join(n, "new_uuid"), now).where("invalidated")
        return hit.groupBy(F.col("uuid").alias("__u")).agg(F.min("new_invalid_at").alias("__i"), F.min("new_expired_at").alias("__x"))

    @staticmethod
    def _mentions(facts: DataFrame) -> DataFrame:
        ends = facts.select(F.explode("episodes").alias("__e"), F.array("source_node_uuid", "target_node_uuid").alias("__n"))
        return ends.select(F.col("__e").alias("source_node_uuid"), F.explode("__n").alias("target_node_uuid")).distinct()

    def nodes_and_edges_of(self, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        edges = self.table("edges").withColumn("__e", F.explode("episodes")).join(episodes.select(F.col("uuid").alias("__e")), "__e", "left_semi")
        return graph.mentioned_nodes(self.table("entities"), self.table("mentions"), episodes), edges.drop("__e").dropDuplicates(["uuid"])

    def remove_episodes(self, episodes: DataFrame) -> None:
        """Remove episodes with the facts they were first to state and the nodes that only they mention."""
        lineage = Lineage(self.spark)

        def work() -> None:
            gone = lineage.cut(store.removed_with_episode(self.table("edges"), self.table("mentions"), episodes))
            of = lambda kind, name="uuid": gone.where(F.col("kind") == kind).select(F.col("uuid").alias(name))
            edges = self.table("edges")
            at_ends = [edges.join(of("node", end), end, "left_semi").select("uuid") for end in ("source_node_uuid", "target_node_uuid")]
            self.delete("edges", of("edge").union(at_ends[0]).union(at_ends[1]))
            self.delete("mentions", self.table("mentions").join(of("episode", "source_node_uuid"), "source_node_uuid", "left_semi").select("uuid"))
            self.delete("entities", of("node"))
            self.delete("episodes", of("episode"))

        self.change(work)

    # ---- communities, search, export

    def build_communities(self, summarize: Callable[[Column], Column] = T.truncate_at_sentence) -> None:
        """All communities anew, by label propagation over the facts of each group. A summary is made of the names of all members."""
        self.change(lambda: self._build_communities(summarize))

    def _build_communities(self, summarize: Callable[[Column], Column]) -> None:
        lineage = Lineage(self.spark)
        nodes = self.table("entities")
        group = nodes.select("uuid", "group_id")
        inside = self.table("edges").join(group.select(F.col("uuid").alias("source_node_uuid"), F.col("group_id").alias("__s")), "source_node_uuid")
        inside = inside.join(group.select(F.col("uuid").alias("target_node_uuid"), F.col("group_id").alias("__t")), "target_node_uuid").where(F.col("__s").eqNullSafe(F.col("__t")))
        found = lineage.cut(graph.label_propagation(lineage.cut(graph.neighbours(inside)), lineage))
        rows = found.join(nodes, "uuid").select(F.concat(F.lit("k_"), "community").alias("k"), "uuid", "name", "group_id", "created_at")
        groups = rows.groupBy("k").agg(F.min("group_id").alias("group_id"), F.max("created_at").alias("created_at"), F.min("name").alias("name"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("summary"))
        self.replace("communities", groups.select(F.col("k").alias("uuid"), "name", "group_id", "created_at", summarize(F.col("summary")).alias("summary")))
        self.replace("members", rows.select(F.concat(F.lit("hm_"), "k", F.lit("_"), "uuid").alias("uuid"), "group_id", F.col("k").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"), "created_at"))

    def update_communities(self, nodes: DataFrame, summarize: Callable[[Column], Column] = T.truncate_at_sentence) -> None:
        """Put nodes(uuid) without a community into the one most frequent among their neighbours, if there is one. The
        communities that grow get a new summary, made of the one they had and the names that came."""
        self.change(lambda: self._update_communities(nodes, summarize))

    def _update_communities(self, nodes: DataFrame, summarize: Callable[[Column], Column]) -> None:
        members = self.table("members")
        free = nodes.select("uuid").join(members.select(F.col("target_node_uuid").alias("uuid")), "uuid", "left_anti").distinct()
        best = graph.community_mode(graph.neighbours(self.table("edges")).join(free, "uuid", "left_semi"), members)
        rows = Lineage(self.spark).cut(best.join(self.table("entities").select("uuid", "name", "group_id", "created_at"), "uuid"))
        came = rows.groupBy(F.col("community").alias("uuid")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("__came"))
        grown = self.table("communities").join(came, "uuid").withColumn("summary", summarize(F.concat_ws(", ", F.when(F.col("summary") != "", F.col("summary")), "__came")))
        self._open.upsert("communities", grown.drop("__came"))
        self.upsert("members", rows.select(F.concat(F.lit("hm_"), "community", F.lit("_"), "uuid").alias("uuid"), "group_id", F.col("community").alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"), "created_at"))

    def remove_communities(self) -> None:
        self.change(lambda: [self.replace(name, self.table(name).limit(0)) for name in ("communities", "members")])

    def search(
        self, query: str, vector: list[float] | None = None, recipe: str = "combined_rrf", where: filters.SearchFilters = filters.SearchFilters(), center: str | None = None, origins: DataFrame | None = None,
        encoder: retrieval.Encoder = retrieval.lexical_cross_encoder,
    ) -> dict[str, DataFrame]:
        """(uuid, score) of each scope of the recipe, best first. A blank query finds nothing. Labels bind facts by both their ends."""
        found = retrieval.RECIPES[recipe]
        fields = {"edges": (["name", "fact"], "fact_embedding"), "entities": (["name", "summary"], "name_embedding"), "episodes": (["content", "source", "source_description"], None), "communities": (["name"], "name_embedding")}
        scopes = {"edges": found.edges, "entities": found.nodes, "episodes": found.episodes, "communities": found.communities}
        places = self.table("entities").select("uuid", "group_id").unionByName(self.table("episodes").select("uuid", "group_id")).where(filters.in_groups(F.col("group_id"), where.group_ids))
        around = retrieval.Surroundings(self.table("edges"), self.table("mentions"), center, origins, places, encoder)
        out = {}
        for name, of in scopes.items():
            if of and query.strip():
                rows = where.apply(self.table(name))
                rows = filters.labelled_ends(rows, self.table("entities"), where.node_labels) if name == "edges" else rows
                out[name] = retrieval.hybrid(rows, query, vector, *fields[name], of, "nodes" if name == "entities" else name, around, self._by_text(name, where))
        return out

    def _by_text(self, name: str, where: filters.SearchFilters) -> Callable[[DataFrame, str, int], DataFrame]:
        """Full text for ``hybrid``: from the index where it shows the table as it is, else by a scan; statistics are those
        of the whole table either way, so the scores are the same."""
        index, manifest = TextIndex(self.versions, name, self.INDEXED[name]), self.versions.manifest()
        if index.fresh(manifest):
            return lambda rows, query, most: index.search(query, most, manifest, rows if where != filters.SearchFilters() else None)
        return lambda rows, query, most: retrieval.bm25(rows, query, self.INDEXED[name], most, self.table(name))

    INDEXED = {"edges": ["name", "fact"], "entities": ["name", "summary"], "episodes": ["content", "source", "source_description"], "communities": ["name"]}

    def build_indices(self) -> None:
        """Bring the inverted indices of all texts up to the tables as they are now: what has changed since the last time
        becomes a segment. Searches read them until a table changes again, and scan that table from then on."""
        for name, columns in self.INDEXED.items():
            TextIndex(self.versions, name, columns).refresh()

    def search_text(self, scope: str, query: str, limit: int = retrieval.LIMIT) -> DataFrame:
        """(uuid, score) by full text from the index of a scope as it was built last."""
        return TextIndex(self.versions, scope, self.INDEXED[scope]).search(query, limit)

    def similar_facts(self, vector: list[float], least: float = retrieval.MIN_SCORE, limit: int = retrieval.LIMIT) -> DataFrame:
        return retrieval.similarity(self.table("edges").where(F.size("fact_embedding") == len(vector)), [float(x) for x in vector], "fact_embedding", least, limit)

    def normalized_embeddings(self) -> DataFrame:
        return self.table("entities").select("uuid", V.l2_normalize(F.col("name_embedding")).alias("name_embedding"))

    def clear(self, groups: list[str] | None = None) -> None:
        self.change(lambda: [self.replace(name, store.delete_groups(self.table(name), groups)) for name in schema.TABLES])

    def statistics(self) -> DataFrame:
        kinds = [self.table(n).groupBy(F.lit(n).alias("type")).agg(F.count(F.lit(1)).alias("n")) for n in schema.TABLES]
        out = kinds[0]
        for k in kinds[1:]:
            out = out.unionByName(k)
        return out

    def drop(self) -> bool:
        """Delete the graph with all generations and indices; whether there was one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def export(self, folder: str, name: str, groups: list[str] | None = None) -> None:
        """nodes_<name> and edges_<name> as tab-separated tables of 13 columns, of all groups or those given."""
        nodes = self.table("entities").withColumn("type", F.lit("Entity")).unionByName(self.table("episodes").withColumn("type", F.lit("Episodic")), allowMissingColumns=True)
        nodes = nodes.unionByName(self.table("communities").withColumn("type", F.lit("Community")), allowMissingColumns=True)
        edges = self.table("edges").withColumn("type", F.lit("RELATES_TO")).unionByName(self.table("mentions").withColumn("type", F.lit("MENTIONS")), allowMissingColumns=True)
        edges = edges.unionByName(self.table("members").withColumn("type", F.lit("HAS_MEMBER")), allowMissingColumns=True)
        inside = filters.in_groups(F.col("group_id"), groups)
        store.export_tsv(nodes.where(inside), schema.NODE_COLUMNS, f"{folder}/nodes_{store.safe_name(name)}")
        store.export_tsv(edges.where(inside), schema.EDGE_COLUMNS, f"{folder}/edges_{store.safe_name(name)}")


def graphs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the graphs below a folder, in order: what holds a table of theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path(folder)):
        return []
    found = [s.getPath() for s in fs.listStatus(path(folder)) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(path(p, "tables/_versions")))
