"""Graph operators: pattern joins, traversal, pointers, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.plans.lineage import Lineage


def with_endpoint_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_name and target_name, null where a node is missing."""
    named = nodes.select(F.col("uuid").alias("__id"), F.col("name").alias("__name"))
    out = edges.join(named, edges.source_node_uuid == F.col("__id"), "left").withColumnRenamed("__name", "source_name").drop("__id")
    return out.join(named, F.col("target_node_uuid") == F.col("__id"), "left").withColumnRenamed("__name", "target_name").drop("__id")


def mentioned_nodes(nodes: DataFrame, mentions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Nodes that one of the episodes mentions, once each."""
    hit = mentions.join(episodes.select(F.col("uuid").alias("source_node_uuid")), "source_node_uuid", "left_semi")
    return nodes.join(hit.select(F.col("target_node_uuid").alias("uuid")), "uuid", "left_semi")


def communities_of(communities: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    hit = members.join(nodes.select(F.col("uuid").alias("target_node_uuid")), "target_node_uuid", "left_semi")
    return communities.join(hit.select(F.col("source_node_uuid").alias("uuid")), "uuid", "left_semi")


def member_links(members: DataFrame, entities: DataFrame, communities: DataFrame) -> DataFrame:
    """(uuid, kind): memberships of entities and of communities in communities, each once; others have no such end."""
    inside = members.join(communities.select(F.col("uuid").alias("source_node_uuid")), "source_node_uuid", "left_semi")
    kinds = [inside.join(nodes.select(F.col("uuid").alias("target_node_uuid")), "target_node_uuid", "left_semi").select("uuid", F.lit(kind).alias("kind")) for nodes, kind in ((entities, "Entity"), (communities, "Community"))]
    return kinds[0].union(kinds[1]).distinct()


def episodes_of(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes that state one of the edges, once each."""
    named = edges.select(F.explode("episodes").alias("uuid"))
    return episodes.join(named, "uuid", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.withColumn("lo", F.least("source_node_uuid", "target_node_uuid")).withColumn("hi", F.greatest("source_node_uuid", "target_node_uuid"))


def edges_between(query: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_uuid, uuid): other edges between the ends of a query edge, either way round, of the same group."""
    q = undirected(query).select(F.col("uuid").alias("query_uuid"), "group_id", "lo", "hi")
    return q.join(undirected(edges).select("uuid", "group_id", "lo", "hi"), ["group_id", "lo", "hi"]).where("uuid <> query_uuid").select("query_uuid", "uuid")


def edges_touching(query: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_uuid, uuid): edges of the group sharing an end with a query edge. One equi-join on exploded ends instead of four with OR."""
    ends = lambda df, name: df.select(F.col("uuid").alias(name), "group_id", F.explode(F.array_distinct(F.array("source_node_uuid", "target_node_uuid"))).alias("end"))
    return ends(query, "query_uuid").join(ends(edges, "uuid"), ["group_id", "end"]).where("uuid <> query_uuid").select("query_uuid", "uuid").distinct()


def edges_within(edges: DataFrame, origins: DataFrame, depth: int, lineage: Lineage) -> DataFrame:
    """(uuid, hop): edges on directed paths of at most ``depth`` edges from origins(uuid), each once with its first hop;
    a depth below 1 finds none."""
    if depth < 1:
        return edges.select("uuid", F.lit(0).alias("hop")).limit(0)
    step = edges.select("uuid", "source_node_uuid", "target_node_uuid")
    front = origins.select("uuid").distinct()
    seen, found = front, None
    for hop in range(1, depth + 1):
        hits = step.join(front.withColumnRenamed("uuid", "source_node_uuid"), "source_node_uuid", "left_semi")
        new = hits.select("uuid", F.lit(hop).alias("hop"))
        found = new if found is None else found.unionByName(new)
        front = hits.select(F.col("target_node_uuid").alias("uuid")).distinct().join(seen, "uuid", "left_anti")
        if hop < depth:
            front = lineage.cut(front)
            seen = lineage.cut(seen.unionByName(front))
    return found.groupBy("uuid").agg(F.min("hop").alias("hop"))


def nodes_within(edges: DataFrame, origins: DataFrame, depth: int, lineage: Lineage) -> DataFrame:
    """(uuid, hop): targets of the edges within reach, whatever their groups, with the first hop that comes to them."""
    reached = edges_within(edges, origins, depth, lineage).withColumnRenamed("uuid", "__edge")
    return reached.join(edges.select(F.col("uuid").alias("__edge"), F.col("target_node_uuid").alias("uuid")), "__edge").groupBy("uuid").agg(F.min("hop").alias("hop"))


def nodes_of_group_within(links: DataFrame, origins: DataFrame, nodes: DataFrame, depth: int, lineage: Lineage) -> DataFrame:
    """(uuid, hop): nodes(uuid, group_id) at the end of a directed path of at most ``depth`` links from an
    origin(uuid, group_id) of their own group, with the fewest links. What lies between may be of any group; an origin
    on a circle is found itself. A depth below 1 finds none, nor does an origin without a group."""
    if depth < 1:
        return nodes.select("uuid", F.lit(0).alias("hop")).limit(0)
    step = links.select(F.col("source_node_uuid").alias("uuid"), F.col("target_node_uuid").alias("__to"))
    front = origins.select("uuid", "group_id").distinct()
    seen, found = front, None
    for hop in range(1, depth + 1):
        ends = lineage.cut(step.join(front, "uuid").select(F.col("__to").alias("uuid"), "group_id").distinct())
        new = ends.withColumn("hop", F.lit(hop))
        found = new if found is None else found.unionByName(new)
        if hop < depth:
            front = ends.join(seen, ["uuid", "group_id"], "left_anti")
            seen = seen.unionByName(front)
    return found.join(nodes.select("uuid", "group_id"), ["uuid", "group_id"], "left_semi").groupBy("uuid").agg(F.min("hop").alias("hop"))


def repoint(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    """Edges with both ends sent through pointers(uuid, canonical); other ends stay."""
    for end in ("source_node_uuid", "target_node_uuid"):
        to = pointers.select(F.col("uuid").alias("__u"), F.col("canonical").alias("__c"))
        edges = edges.join(to, F.col(end) == F.col("__u"), "left").withColumn(end, F.coalesce("__c", end)).drop("__u", "__c")
    return edges


def components(pairs: DataFrame, lineage: Lineage, rounds: int = 50) -> DataFrame:
    """(uuid, canonical) for pairs(a, b): the smallest uuid that can be reached.

    Star contractions (Kiveris et al. 2014): each node hands its larger neighbours to the smallest one, then the
    smaller ones; a round is written once, and it ends when two rounds give the same links. A pair of a uuid with
    itself is a component of its own.
    """
    ends = lambda df: df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    whole = lineage.cut(ends(pairs).distinct())
    links, seen = whole.where("hi <> lo"), None
    for _ in range(rounds):
        both = links.union(links.select("lo", "hi").toDF("hi", "lo"))
        least = both.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, F.col("hi") == F.col("k")).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
        small = large.join(least, F.col("hi") == F.col("k"))
        links = lineage.cut(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
        state = links.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(k), "hi", "lo").cast("decimal(20,0)")) for k in (0, 1))).first()
        if state == seen:
            tops = links.select("lo").distinct().select(F.col("lo").alias("uuid"), F.col("lo").alias("canonical"))
            found = links.select(F.col("hi").alias("uuid"), F.col("lo").alias("canonical")).union(tops)
            alone = whole.where("hi = lo").select(F.col("hi").alias("uuid")).distinct().join(found, "uuid", "left_anti").select("uuid", F.col("uuid").alias("canonical"))
            return found.union(alone)
        seen = state
    raise RuntimeError("components did not settle")


def follow(pointers: DataFrame, lineage: Lineage, rounds: int = 40) -> DataFrame:
    """Directed chains uuid -> canonical followed to their ends; each uuid points to one canonical."""
    now = lineage.cut(pointers.select("uuid", "canonical"))
    for _ in range(rounds):
        ahead = now.select(F.col("uuid").alias("__u"), F.col("canonical").alias("__c"))
        next_ = lineage.cut(now.join(ahead, now.canonical == F.col("__u"), "left").select("uuid", F.coalesce("__c", "canonical").alias("canonical")))
        done = next_.join(now.withColumnRenamed("canonical", "old"), "uuid").where("canonical <> old").isEmpty()
        now = next_
        if done:
            return now
    raise RuntimeError("pointers form a circle")


def follow_ordered(pairs: DataFrame, lineage: Lineage, rounds: int = 64) -> DataFrame:
    """(uuid, canonical) of pairs(ord, a, b) worked off one after another by ord, a, b: the root of a comes under the root
    of b, unless they are one. Every uuid of the pairs has one row; pairs that lack an end are left out.

    Groups known by their roots grow in rounds, without working the pairs off one by one. Each group points over its
    first pair to another group: that makes trees, whose first pair joins two groups that point at each other. Before the
    first pair that leaves a tree, the pairs the groups point over are worked off in their order, and each joins one more
    group to those joined so far; so the root of all that are joined is that of the last group that stood as b. Trees
    that are not alone each meet another one in the next round, so their number halves; a tree alone is done at once.
    """
    step = F.struct("ord", "a", "b").alias("step")
    links = lineage.cut(pairs.where("a is not null and b is not null").select(step, F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    roots = lineage.cut(links.select(F.col("src").alias("uuid")).union(links.select("dst")).distinct().select("uuid", F.col("uuid").alias("canonical")))
    links = links.where("src <> dst")
    for _ in range(rounds):
        if links.isEmpty():
            return roots
        ends = links.select("step", F.col("src").alias("root"), F.col("dst").alias("other"), F.lit(False).alias("above")).union(links.select("step", "dst", "src", F.lit(True)))
        first = lineage.cut(ends.groupBy("root").agg(F.min(F.struct("step", "other", "above")).alias("m")).select("root", "m.*"))
        facing = first.select(F.col("root").alias("other"), F.col("step").alias("back"))
        pointers = first.join(facing, "other").select(F.col("root").alias("uuid"), F.when(F.col("above") & (F.col("step") == F.col("back")), F.col("root")).otherwise(F.col("other")).alias("canonical"))
        trees = follow(pointers, lineage).select(F.col("uuid").alias("root"), F.col("canonical").alias("tree"))
        side = lambda c: trees.select(F.col("root").alias(c), F.col("tree").alias(f"{c}_tree"))
        leaving = links.join(side("src"), "src").join(side("dst"), "dst").where("src_tree <> dst_tree")
        limits = leaving.select("step", F.explode(F.array("src_tree", "dst_tree")).alias("tree")).groupBy("tree").agg(F.min("step").alias("limit"))
        joined = first.join(trees, "root").join(limits, "tree", "left").where(F.col("limit").isNull() | (F.col("step") < F.col("limit")))
        tops = joined.where("above").groupBy("tree").agg(F.max(F.struct("step", "root")).alias("top")).select("tree", F.col("top.root").alias("into"))
        moves = lineage.cut(joined.select("tree", "root").join(tops, "tree").select("root", "into"))
        for end in ("src", "dst"):
            links = links.join(moves.select(F.col("root").alias(end), "into"), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        links = lineage.cut(links.where("src <> dst").select("step", "src", "dst"))
        roots = lineage.cut(roots.join(moves.withColumnRenamed("root", "canonical"), "canonical", "left").select("uuid", F.coalesce("into", "canonical").alias("canonical")))
    raise RuntimeError("groups did not settle")


def neighbours(edges: DataFrame) -> DataFrame:
    """(uuid, neighbour, weight): number of edges between two nodes, from both sides."""
    both = edges.select(F.col("source_node_uuid").alias("uuid"), F.col("target_node_uuid").alias("neighbour")).union(edges.select("target_node_uuid", "source_node_uuid"))
    return both.where("uuid <> neighbour").groupBy("uuid", "neighbour").agg(F.count(F.lit(1)).alias("weight"))


def label_propagation(links: DataFrame, lineage: Lineage, rounds: int = 1000) -> DataFrame:
    """(uuid, community) for links(uuid, neighbour, weight).

    In each round a node looks at the community of the largest total weight around it (the larger id on ties); it
    joins if that weight is above 1, else it takes the larger of that id and its own. A node that returns to the
    label of two rounds ago would swap for ever: it then keeps the smaller of the two. It ends when nothing changes,
    or when a whole state comes back, as the rounds after it would; after ``rounds`` rounds it raises.
    """
    nodes = links.select("uuid").distinct()
    now = lineage.cut(nodes.select("uuid", F.col("uuid").alias("community"), F.lit(None).cast("string").alias("before")))
    seen: set[tuple] = set()
    for _ in range(rounds):
        votes = links.join(now.select(F.col("uuid").alias("neighbour"), F.col("community").alias("c")), "neighbour").groupBy("uuid", "c").agg(F.sum("weight").alias("w"))
        top = votes.groupBy("uuid").agg(F.max(F.struct("w", "c")).alias("top"))
        moved = now.join(top, "uuid").withColumn("wanted", F.when(F.col("top.w") > 1, F.col("top.c")).otherwise(F.greatest("top.c", "community")))
        swap = F.col("before").isNotNull() & (F.col("wanted") == F.col("before")) & (F.col("wanted") != F.col("community"))
        moved = moved.select("uuid", F.when(swap, F.least("wanted", "community")).otherwise(F.col("wanted")).alias("community"), F.col("community").alias("before"))
        now = lineage.cut(moved)
        changed, *state = now.agg(F.count_if(F.col("community") != F.col("before")), *(F.sum(F.xxhash64(F.lit(k), "uuid", "community", "before").cast("decimal(20,0)")) for k in (0, 1))).first()
        if not changed or tuple(state) in seen:
            return now.select("uuid", "community")
        seen.add(tuple(state))
    raise RuntimeError("communities did not settle")


def community_mode(links: DataFrame, members: DataFrame) -> DataFrame:
    """(uuid, community): the community most frequent among a node's neighbours, the smaller uuid on ties."""
    joined = links.select("uuid", "neighbour").join(members.select(F.col("target_node_uuid").alias("neighbour"), F.col("source_node_uuid").alias("community")), "neighbour")
    votes = joined.groupBy("uuid", "community").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("uuid").orderBy(F.desc("n"), "community")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("uuid", "community", "n")


def membership_edges(pairs: DataFrame, prefix: str) -> DataFrame:
    """One edge for each (source_node_uuid, target_node_uuid) of pairs: episode to node, community to member."""
    return pairs.select(F.concat(F.lit(prefix), "source_node_uuid", F.lit("_"), "target_node_uuid").alias("uuid"), "source_node_uuid", "target_node_uuid").distinct()
