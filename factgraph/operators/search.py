"""Retrieval: full text, vectors, fusion and reranking.

Scores are columns of the rows scored; ranks are made with ties broken by uuid. A query vector or the query's words
are literals in the plan, so scoring is one narrow pass and the top rows come by TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.functions import vectors as V
from factgraph.operators import graph
from factgraph.operators.nearest import best, nearest
from factgraph.plans.lineage import Lineage

K1, B = 1.2, 0.75
RRF_CONST = 1
MIN_SCORE = 0.6
LIMIT = 10
#: So many rows are a short list.
SHORT = 10_000


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term)).cast("double")


def bm25(docs: DataFrame, query: str, columns: list[str], limit: int | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """docs with score > 0 against the query's words, BM25 over the text of ``columns``; statistics are those of the
    corpus, of which docs may be a part, or of docs.

    Word frequencies of the few query words are counted in the row, corpus statistics in one aggregation to a single
    row; no inverted index is exploded or shuffled. A query without words finds nothing.
    """
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__t", T.tokens(F.concat_ws(" ", *columns)))
        rows = rows.withColumn("__dl", F.size("__t").cast("double"))
        for i, term in enumerate(terms):
            rows = rows.withColumn(f"__tf{i}", _times(F.col("__t"), term))
        return rows.drop("__t")

    held = counted(docs)
    stats = (held if corpus is None else counted(corpus)).agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.avg("__dl").alias("__avgdl"),
        *(F.sum((F.col(f"__tf{i}") > 0).cast("double")).alias(f"__df{i}") for i in range(len(terms))),
    )

    def part(i: int) -> Column:
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(F.lit(1.0) + (F.col("__n") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.col("__avgdl")))

    hit = reduce(lambda a, b: a | b, [F.col(f"__tf{i}") > 0 for i in range(len(terms))])
    out = held.where(hit).crossJoin(F.broadcast(stats))  # one row of statistics
    out = out.withColumn("score", reduce(add, [part(i) for i in range(len(terms))])).select(*docs.columns, "score")
    return out.orderBy(F.desc("score"), "uuid").limit(limit) if limit else out


def similarity(rows: DataFrame, query: list[float], column: str, least: float = MIN_SCORE, limit: int | None = LIMIT, scale: str = "unit") -> DataFrame:
    """rows whose score against the query vector is above ``least``, best first."""
    out = rows.withColumn("score", V.scaled_cosine(V.doubles(F.col(column)), V.literal(query), scale)).where(F.col("score") > least)
    return out.orderBy(F.desc("score"), "uuid").limit(limit) if limit else out


def ranked(rows: DataFrame, method: int, most: int | None = None) -> DataFrame:
    """(uuid, method, rank) of a result list, rank from 0 by falling score. One window sees the list: ``most`` cuts it before."""
    rows = rows.orderBy(F.desc("score"), "uuid").limit(most) if most else rows
    return rows.select("uuid", F.lit(method).alias("method"), (F.row_number().over(Window.orderBy(F.desc("score"), "uuid")) - 1).alias("rank"))


def rrf(lists: DataFrame, least: float = 0.0) -> DataFrame:
    """(uuid, score) of lists(uuid, method, rank): sum of 1 / (rank + 1); ties stand in the order first seen."""
    out = lists.groupBy("uuid").agg(F.sum(F.lit(1.0) / (F.col("rank") + RRF_CONST)).alias("score"), F.min(F.struct("method", "rank")).alias("seen"))
    return out.where(F.col("score") >= least)


def fused(lists: DataFrame, limit: int | None = None) -> DataFrame:
    out = rrf(lists)
    return out.orderBy(F.desc("score"), "seen").limit(limit).select("uuid", "score") if limit else out.select("uuid", "score")


def mmr(candidates: DataFrame, query: list[float], weight: float = 0.5, column: str = "embedding") -> DataFrame:
    """(uuid, score) of a short list: weight * relevance - (1 - weight) * largest likeness to another candidate, at least 0."""
    if candidates.count() > SHORT:
        raise ValueError(f"mmr compares all pairs of a short list, of {SHORT} rows at most")
    unit = candidates.select("uuid", V.l2_normalize(V.doubles(F.col(column))).alias("v"))
    other = unit.select(F.col("uuid").alias("__o"), F.col("v").alias("__v"))
    likeness = unit.join(F.broadcast(other), F.col("uuid") != F.col("__o")).groupBy("uuid").agg(F.max(V.dot(F.col("v"), F.col("__v"))).alias("m"))
    scored = unit.join(likeness, "uuid", "left").withColumn("m", F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))))
    return scored.select("uuid", (F.lit(weight) * V.dot(V.literal(query), F.col("v")) + F.lit(weight - 1) * F.col("m")).alias("score"))


def node_distance(candidates: DataFrame, edges: DataFrame, center: str) -> DataFrame:
    """(uuid, score): 10 for the centre, 1 for its neighbours, 0 for others."""
    near = edges.where(F.col("source_node_uuid") == center).select(F.col("target_node_uuid").alias("uuid")).union(edges.where(F.col("target_node_uuid") == center).select("source_node_uuid"))
    near = near.distinct().withColumn("near", F.lit(1.0))
    return candidates.select("uuid").distinct().join(near, "uuid", "left").select("uuid", F.when(F.col("uuid") == center, 10.0).otherwise(F.coalesce("near", F.lit(0.0))).alias("score"))


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("mentions"))


def by_mentions(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """(uuid, mentions): candidates by rising number of mentions; infinite where there is none."""
    return candidates.join(mention_counts(mentions), "uuid", "left").select("uuid", F.coalesce(F.col("mentions").cast("double"), F.lit(float("inf"))).alias("mentions"))


def lexical_cross_encoder(query: str, passage: Column) -> Column:
    """Stand-in for a cross encoder: the share of the query's words that the passage holds."""
    terms = query_terms(query)
    held = T.tokens(passage)
    return F.size(F.array_intersect(F.array(*map(F.lit, terms)), held)).cast("double") / float(max(1, len(terms)))


#: (query, column of passages) -> column of scores: a Pandas or Arrow UDF round a model, or built-in functions.
Encoder = Callable[[str, Column], Column]


def cross_encoded(candidates: DataFrame, query: str, column: str, least: float = 0.0, encoder: Encoder = lexical_cross_encoder) -> DataFrame:
    """(uuid, score) with one row for each different text, that of the last uuid."""
    last = candidates.groupBy(column).agg(F.max("uuid").alias("uuid"))
    return last.select("uuid", encoder(query, F.col(column)).cast("double").alias("score")).where(F.col("score") >= least)


@dataclass(frozen=True)
class Recipe:
    """What a search of one scope runs: methods 'bm25', 'cosine', 'bfs'; reranker 'rrf', 'mmr', 'node_distance', 'episode_mentions' or 'cross_encoder'."""

    methods: tuple[str, ...] = ("bm25", "cosine")
    reranker: str = "rrf"
    limit: int = LIMIT
    least: float = MIN_SCORE
    mmr_weight: float = 0.5
    bfs_depth: int = 3
    reranker_least: float = 0.0


@dataclass(frozen=True)
class CombinedRecipe:
    edges: Recipe | None = field(default_factory=Recipe)
    nodes: Recipe | None = field(default_factory=Recipe)
    episodes: Recipe | None = field(default_factory=lambda: Recipe(("bm25",)))
    communities: Recipe | None = field(default_factory=Recipe)


def _recipes() -> dict[str, CombinedRecipe]:
    """All presets: combined with three rerankers, and one scope alone with each reranker it has."""
    found = {
        "combined_rrf": CombinedRecipe(),
        "combined_mmr": CombinedRecipe(Recipe(reranker="mmr", mmr_weight=1), Recipe(reranker="mmr", mmr_weight=1), Recipe(("bm25",)), Recipe(reranker="mmr", mmr_weight=1)),
        "combined_cross_encoder": CombinedRecipe(
            Recipe(("bm25", "cosine", "bfs"), "cross_encoder"), Recipe(("bm25", "cosine", "bfs"), "cross_encoder"), Recipe(("bm25",), "cross_encoder"), Recipe(reranker="cross_encoder")
        ),
    }
    for scope, rerankers in (("edges", 5), ("nodes", 5), ("communities", 3)):
        for name in ("rrf", "mmr", "cross_encoder", "node_distance", "episode_mentions")[:rerankers]:
            methods = ("bm25", "cosine", "bfs") if name == "cross_encoder" and scope != "communities" else ("bm25", "cosine")
            found[f"{scope}_{name}"] = CombinedRecipe(**({k: None for k in ("edges", "nodes", "episodes", "communities")} | {scope: Recipe(methods, name)}))
    return found


RECIPES = _recipes()


@dataclass(frozen=True)
class Surroundings:
    """What traversal and rerankers read beside the rows searched: facts, mentions, a centre, origins(uuid) to start from,
    and places(uuid, group_id) of what may be an origin; the rows searched where there are none. Mentions with both ends
    are ways from an episode to its nodes."""

    edges: DataFrame | None = None
    mentions: DataFrame | None = None
    center: str | None = None
    origins: DataFrame | None = None
    places: DataFrame | None = None
    #: what the cross encoder scores passages with
    encoder: Encoder = lexical_cross_encoder


#: By scope: the rerankers it has, and the text a cross encoder reads.
RERANKERS = {
    "edges": ("rrf", "mmr", "cross_encoder", "node_distance", "episode_mentions"),
    "nodes": ("rrf", "mmr", "cross_encoder", "node_distance", "episode_mentions"),
    "episodes": ("rrf", "cross_encoder"),
    "communities": ("rrf", "mmr", "cross_encoder"),
}
PASSAGES = {"edges": "fact", "nodes": "name", "episodes": "content", "communities": "name"}


def _traversed(rows: DataFrame, recipe: Recipe, scope: str, around: Surroundings, hits: list[DataFrame]) -> DataFrame | None:
    """(uuid, score) of rows within reach, nearer ones first. Without origins it starts from what other methods found:
    from the nodes, or from the sources of the facts."""
    edges = rows if scope == "edges" else around.edges
    origins = around.origins
    if edges is None:
        raise ValueError("traversal from nodes needs edges")
    if origins is None and hits:
        found = reduce(DataFrame.unionByName, hits).select("uuid").distinct()
        origins = found if scope == "nodes" else rows.join(found, "uuid", "left_semi").select(F.col("source_node_uuid").alias("uuid"))
    if origins is None:
        return None
    ends, lineage = ["uuid", "source_node_uuid", "target_node_uuid"], Lineage(rows.sparkSession)
    links = edges.select(*ends)
    if around.mentions is not None and set(ends) <= set(around.mentions.columns):
        links = links.unionByName(around.mentions.select(*ends))
    if scope == "edges":
        reach = graph.edges_within(links, origins, recipe.bfs_depth, lineage)
    else:
        grouped = (rows if around.places is None else around.places).select("uuid", "group_id").join(origins.select("uuid"), "uuid", "left_semi")
        reach = graph.nodes_of_group_within(links, grouped, rows, recipe.bfs_depth, lineage)
    return reach.join(rows.select("uuid"), "uuid", "left_semi").select("uuid", (-F.col("hop")).cast("double").alias("score"))


def _reranked(rows: DataFrame, lists: DataFrame, query: str, vector: list[float] | None, embedding: str | None, recipe: Recipe, scope: str, around: Surroundings) -> DataFrame:
    """(uuid, score, place) of the lists' rows by the recipe's reranker; the smaller place comes first."""
    order = rrf(lists, 0.0 if recipe.reranker != "rrf" else recipe.reranker_least)
    place = lambda *by: F.struct(*(c.alias(f"p{i}") for i, c in enumerate(by)))
    fusion = (-F.col("score"), F.col("seen"))
    if recipe.reranker == "rrf":
        return order.select("uuid", "score", place(*fusion).alias("place"))
    seen = order.select("uuid", F.col("score").alias("fused"), place(*fusion).alias("fusion"))
    if recipe.reranker == "mmr":
        if not vector or not embedding:
            raise ValueError("mmr needs a query vector and embeddings")
        scored = mmr(rows.join(seen, "uuid").select("uuid", embedding), vector, recipe.mmr_weight, embedding).where(F.col("score") >= recipe.reranker_least)
        return scored.select("uuid", "score", place(-F.col("score"), F.col("uuid")).alias("place"))
    if recipe.reranker == "cross_encoder":
        first = order.orderBy("seen").limit(recipe.limit) if scope == "edges" else order  # of facts only so many are read
        scored = cross_encoded(rows.join(first.select("uuid"), "uuid", "left_semi"), query, PASSAGES[scope], recipe.reranker_least, around.encoder)
        return scored.select("uuid", "score", place(-F.col("score"), F.col("uuid")).alias("place"))
    if recipe.reranker == "node_distance":
        edges = rows if scope == "edges" else around.edges
        if around.center is None or edges is None:
            raise ValueError("node distance needs a centre and edges")
        if scope == "nodes":
            return node_distance(seen, edges, around.center).where(F.col("score") >= recipe.reranker_least).join(seen, "uuid").select("uuid", "score", place(-F.col("score"), F.col("fusion")).alias("place"))
        facts = rows.select("uuid", "source_node_uuid").join(seen, "uuid")
        sources = facts.groupBy("source_node_uuid").agg(F.min("fusion").alias("head"))
        far = node_distance(sources.withColumnRenamed("source_node_uuid", "uuid"), edges, around.center).where(F.col("score") >= recipe.reranker_least).withColumnRenamed("uuid", "source_node_uuid")
        joined = facts.join(sources.join(far, "source_node_uuid"), "source_node_uuid")
        return joined.select("uuid", "score", place(-F.col("score"), F.col("head"), F.col("fusion")).alias("place"))
    if scope == "nodes":
        if around.mentions is None:
            raise ValueError("ranking nodes by mentions needs mentions")
        counted = by_mentions(seen, around.mentions).where(F.col("mentions") >= recipe.reranker_least).join(seen, "uuid")
        return counted.select("uuid", F.col("mentions").alias("score"), place(F.col("mentions"), F.col("fusion")).alias("place"))
    counted = rows.select("uuid", F.size("episodes").alias("n")).join(seen, "uuid")
    return counted.select("uuid", F.col("fused").alias("score"), place(-F.col("n"), F.col("fusion")).alias("place"))


def hybrid(
    rows: DataFrame, query: str, vector: list[float] | None, columns: list[str], embedding: str | None, recipe: Recipe = Recipe(), scope: str = "nodes", around: Surroundings = Surroundings(), by_text: Callable[[DataFrame, str, int], DataFrame] | None = None
) -> DataFrame:
    """(uuid, score) of rows by the recipe, best first: each of its methods gives twice the limit, its reranker orders
    what they found. A reranker that the scope lacks, or that lacks what it reads, raises. ``by_text`` takes the place of
    a scan for full text: rows, query and limit to (uuid, score)."""
    if recipe.reranker not in RERANKERS[scope]:
        raise ValueError(f"{scope} cannot be ranked by {recipe.reranker}")
    unknown = set(recipe.methods) - {"bm25", "cosine", "bfs"}
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    most, hits = 2 * recipe.limit, []
    if "bm25" in recipe.methods and query.strip():
        hits.append((by_text(rows, query, most) if by_text else bm25(rows, query, columns, most)).select("uuid", "score"))
    if "cosine" in recipe.methods and vector and embedding:
        hits.append(similarity(rows, vector, embedding, recipe.least, most).select("uuid", "score"))
    if "bfs" in recipe.methods and scope in ("edges", "nodes"):
        reached = _traversed(rows, recipe, scope, around, hits)
        hits += [reached] if reached is not None else []
    if not hits:
        return rows.select("uuid", F.lit(0.0).alias("score")).limit(0)
    lists = reduce(DataFrame.unionByName, [ranked(h, i, most) for i, h in enumerate(hits)])
    return _reranked(rows, lists, query, vector, embedding, recipe, scope, around).orderBy("place").limit(recipe.limit).select("uuid", "score")


def relevant_nodes(query: DataFrame, nodes: DataFrame, embedding: str | None, least: float = MIN_SCORE, limit: int | None = LIMIT, text: str | None = None) -> DataFrame:
    """(query_uuid, uuid, score): for each node of query the most alike others of its group, ``limit`` of them by vectors.

    With ``text`` it also takes ``limit`` by full text of that column, the words of the query node's own, and the score
    is that of both lists fused: the sum of 1 / (place + 1)."""
    found = None
    if embedding:
        side = lambda df: df.select("uuid", F.col("group_id").alias("grp"), V.doubles(F.col(embedding)).alias("v"))
        found = nearest(side(query), side(nodes), 2 * least - 1, limit, Lineage(nodes.sparkSession))
        found = found.select("query_uuid", "uuid", ((F.col("cosine") + 1) / 2).alias("score")).where(F.col("score") > least)
    if not text:
        return found
    lists = [relevant_by_text(query, nodes, text, limit)] + ([found] if embedding else [])
    placed = [x.select("query_uuid", "uuid", F.row_number().over(Window.partitionBy("query_uuid").orderBy(F.desc("score"), "uuid")).alias("place")) for x in lists]  # lists of ``limit``
    return reduce(DataFrame.unionByName, placed).groupBy("query_uuid", "uuid").agg(F.sum(F.lit(1.0) / F.col("place")).alias("score"))


#: A word of more nodes of a group is common there.
COMMON = 1000


def relevant_by_text(query: DataFrame, nodes: DataFrame, text: str, limit: int | None = LIMIT) -> DataFrame:
    """(query_uuid, uuid, score): for each node of query the others of its group by BM25 of ``text``, statistics being
    those of the group.

    With a limit nodes that share a word that is not common with the query are met by these words, and score by all
    words. Of all others the score hangs on the common words alone: queries with the same ones share a list, and nodes
    with the same ones, as often and among as many words, are one class, of which the first limit + 1 uuids are enough.
    A node that is better by its other words as well is in the list with less than its score, and takes the larger."""
    words = lambda df: df.select("uuid", "group_id", T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    lineage = Lineage(nodes.sparkSession)
    held = words(nodes).withColumn("dl", F.size("t").cast("double"))
    size = held.groupBy("group_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    found = held.select("uuid", "group_id", "dl", F.explode("t").alias("term")).groupBy("group_id", "term", "uuid", "dl").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    found = lineage.cut(found) if limit else found
    common = found.groupBy("group_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df")).join(size, "group_id")
    common = lineage.cut(common) if limit else common
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    total = F.round(F.sum("part"), 9).alias("score")  # sums of any order tie
    asked = words(query).select(F.col("uuid").alias("query_uuid"), "group_id", F.explode(F.array_distinct("t")).alias("term")).join(common, ["group_id", "term"])
    if not limit:
        return asked.join(found.join(common, ["group_id", "term"]).select("group_id", "term", "uuid", part.alias("part")), ["group_id", "term"]).where("uuid <> query_uuid").groupBy("query_uuid", "uuid").agg(total)
    asked = lineage.cut(asked.select("query_uuid", "group_id", "term", (F.col("df") > COMMON).alias("many")))
    parts = lineage.cut(found.join(common, ["group_id", "term"]).select("group_id", "term", "uuid", "dl", "tf", part.alias("part"), (F.col("df") > COMMON).alias("many")))
    pairs = lambda rows: rows.where("uuid <> query_uuid").groupBy("query_uuid", "uuid")
    few = asked.where("not many").join(parts.where("not many").select("group_id", "term", "uuid", "part"), ["group_id", "term"])
    few = pairs(few).agg(F.first("group_id", True).alias("group_id"), F.sum("part").alias("part"))
    # Of these pairs the common words, which both sides hold as a map.
    mine = asked.where("many").groupBy("query_uuid", "group_id").agg(F.array_sort(F.collect_set("term")).alias("profile"))
    theirs = parts.where("many").groupBy("uuid", "group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "part")))).alias("parts"))
    both = few.drop("group_id").join(mine.select("query_uuid", "profile"), "query_uuid", "left").join(theirs.select("uuid", "parts"), "uuid", "left")
    also = F.aggregate("profile", F.lit(0.0), lambda x, t: x + F.coalesce(F.element_at("parts", t), F.lit(0.0)))
    exact = both.select("query_uuid", "uuid", F.round(F.col("part") + F.coalesce(also, F.lit(0.0)), 9).alias("score"))
    # By common words alone.
    alike = F.transform(F.array_sort(F.collect_list(F.struct("term", "tf", "part"))), lambda x: F.struct(x["term"].alias("term"), x["part"].alias("part")))
    classes = parts.where("many").groupBy("uuid", "group_id", "dl").agg(alike.alias("class"))
    members = best(classes.select(F.to_json(F.struct("group_id", "class")).alias("query_uuid"), "uuid", F.lit(0.0).alias("score"), "group_id", "class"), limit + 1)
    members = lineage.cut(members.select(F.col("query_uuid").alias("of"), "group_id", "class", "uuid"))
    profiles = mine.select("group_id", "profile").distinct().select("group_id", "profile", F.to_json(F.struct("group_id", "profile")).alias("by"))
    kinds = members.select("of", "group_id", "class").distinct().select("of", "group_id", F.inline("class"))
    met = profiles.select("by", "group_id", F.explode("profile").alias("term")).join(kinds, ["group_id", "term"]).groupBy("by", "of").agg(total)
    lists = best(met.join(members.select("of", "uuid"), "of").select(F.col("by").alias("query_uuid"), "uuid", "score"), limit + 1)
    near = mine.select("query_uuid", F.to_json(F.struct("group_id", "profile")).alias("by")).join(lists.select(F.col("query_uuid").alias("by"), "uuid", "score"), "by")
    return best(pairs(exact.unionByName(near.select("query_uuid", "uuid", "score"))).agg(F.max("score").alias("score")), limit)


def invalidation_candidates(query: DataFrame, edges: DataFrame, embedding: str, least: float = MIN_SCORE, limit: int | None = LIMIT) -> DataFrame:
    """(query_uuid, uuid, score): for each edge of query the most alike edges that share an end with it, ``limit`` of them.
    An end is a group of ``nearest``: the edges of a hub meet in products of chunks, of which only each one's best come out."""
    end = F.explode(F.array_distinct(F.array("source_node_uuid", "target_node_uuid")))
    side = lambda df: df.select("uuid", "group_id", end.alias("end"), V.doubles(F.col(embedding)).alias("v")).select("uuid", F.to_json(F.array("group_id", "end")).alias("grp"), "v")
    found = nearest(side(query), side(edges), 2 * least - 1, limit, Lineage(edges.sparkSession), repeated=True)
    return found.select("query_uuid", "uuid", ((F.col("cosine") + 1) / 2).alias("score")).where(F.col("score") > least)


#: Results of each scope, by uuid.
Results = dict[str, DataFrame]


def merged(results: list[Results]) -> Results:
    """Search results of several searches by scope, one after the other; a uuid stands as often as it was found."""
    out: Results = {}
    for found in results:
        for scope, rows in found.items():
            out[scope] = out[scope].unionByName(rows) if scope in out else rows
    return out
