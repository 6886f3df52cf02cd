"""Entity resolution: exact keys, MinHash bands, exact verification, safeguards, canonical ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.functions import vectors as V
from factgraph.operators import graph
from factgraph.operators.nearest import nearest
from factgraph.plans.lineage import Lineage

FUZZY = 0.9
# Places known without a gazetteer.
GEO_HINTS = ("china", "india", "usa", "united states", "france", "germany", "spain", "italy", "brazil", "ethiopia")

GEO_KEYS = ("country", "state", "region", "location_name")


def keyed(names: DataFrame, by: str | None = None) -> DataFrame:
    """(uuid, name, key): the exact and the singular key of each name, and the group ``by`` says, if it is given."""
    group = [_group(by).alias("grp")] if by else []
    return names.select("uuid", "name", *group, F.explode(F.array_distinct(F.array(T.norm_exact(F.col("name")), T.strip_plural(F.col("name"))))).alias("key"))


def _group(by: str) -> Column:
    return F.coalesce(F.col(by), F.lit(""))


def signed(names: DataFrame, n: int = 3) -> DataFrame:
    """names with shingles and LSH bands of names that say enough; others have no band.

    Signatures are made by relations: each different shingle is hashed once for every seed, and the least hashes are
    aggregated by name, as numbers of the first 60 bits, which order and differ as the whole hashes do.
    """
    rows = names.withColumn("fuzzy", T.norm_fuzzy(F.col("name"))).withColumn("shingles", T.shingles(F.col("fuzzy"), n))
    flat = rows.select("fuzzy").distinct().where(T.high_entropy(F.col("fuzzy"))).select("fuzzy", F.explode(T.shingles(F.col("fuzzy"), n)).alias("x"))
    number = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"{s}:"), "x")), 1, 15), 16, 10).cast("long")
    hashed = flat.select("x").distinct().select("x", *(number(s).alias(f"h{s}") for s in range(T.SIGNATURE)))
    hashed = F.broadcast(hashed) if n <= 3 else hashed  # of 37 letters: 50,653 shingles, 13 MB, at most; names are not shuffled with 32 hashes a shingle
    least = flat.join(hashed, "x").groupBy("fuzzy").agg(*(F.min(f"h{s}").cast("string").alias(f"h{s}") for s in range(T.SIGNATURE)))
    bands = least.select(F.col("fuzzy").alias("__f"), T.lsh_bands(F.array(*(f"h{s}" for s in range(T.SIGNATURE)))).alias("bands"))
    out = rows.join(bands, F.col("fuzzy") == F.col("__f"), "left").drop("__f")
    return out.withColumn("bands", F.coalesce("bands", F.array().cast("array<string>")))


def _near_size(n: str, m: str, least: float) -> Column:
    """Sets so unlike in size that their Jaccard similarity stays below ``least`` are no pair."""
    return F.least(n, m) >= F.lit(least) * F.greatest(n, m)


def _shingle_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("shingles").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))


#: Shingles that make one key of a pair, by the larger set's size: three up to the first size, two up to the second.
TRIPLES, COUPLES = 64, 160
#: Below this similarity the rare shingles are too many to be combined.
COMBINED = 0.7


def _combined(o: Column, k: int) -> Column:
    """Hashes of all ``k`` of the ordered values ``o``."""
    rest = lambda i: F.slice(o, i + 2, F.size(o))
    if k == 1:
        return F.transform(o, lambda x: F.xxhash64(F.lit(1), x))
    if k == 2:
        return F.flatten(F.transform(o, lambda x, i: F.transform(rest(i), lambda y: F.xxhash64(F.lit(2), x, y))))
    third = lambda x, i: F.flatten(F.transform(rest(i), lambda y, j: F.transform(F.slice(o, i + j + 3, F.size(o)), lambda z: F.xxhash64(F.lit(3), x, y, z))))
    return F.flatten(F.transform(o, third))


def _rarest(sets: DataFrame, key: str, counts: DataFrame, least: float) -> DataFrame:
    """(key, n, t): keys of which two sets of Jaccard similarity ``least`` or more have one in common, far fewer others do.

    Of a set of n the first n - ceil(least * n) + k shingles in the order of counts(t, df), rare ones first: two such sets
    share k of them, if they share as many at all. So each k of them make a key. How many k is goes by the larger of two
    sizes, so a set has the keys of each k that it may need; sets too small to share k shingles meet by single ones."""
    flat = sets.select(key, F.xxhash64("shingles").alias("set"), F.explode("shingles").alias("t")).join(counts, "t", "left")
    ordered = flat.groupBy(key, "set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("o"))
    ordered = ordered.select(key, F.size("o").alias("n"), F.transform("o", lambda e: e["t"]).alias("o"))
    shared = lambda n: F.ceil(n * F.lit(least) - 1e-9).cast("int")
    first = lambda k: F.slice("o", F.lit(1), F.least(F.size("o"), F.size("o") - shared(F.size("o")) + k))
    if least < COMBINED:
        return ordered.select(key, "n", F.explode(_combined(first(1), 1)).alias("t"))
    each = lambda n: F.when((shared(n) < 3) | (n > COUPLES), 1).when(n > TRIPLES, 2).otherwise(3)
    largest = F.floor(F.col("n") / F.lit(least) + 1e-9)
    none = F.array().cast("array<bigint>")
    needed = [F.when((each(F.col("n")) == k) | (each(largest) == k), _combined(first(k), k)).otherwise(none) for k in (1, 2, 3)]
    return ordered.select(key, "n", F.explode(F.concat(*needed)).alias("t"))


def lsh_pairs(names: DataFrame) -> DataFrame:
    """(a, b) with a < b: names that share a band."""
    rows = signed(names).select(F.col("uuid").alias("a"), F.explode("bands").alias("band"))
    return rows.join(rows.select(F.col("a").alias("b"), "band"), "band").where("a < b").select("a", "b").distinct()


def jaccard_pairs(names: DataFrame, least: float = 0.0, lineage: Lineage | None = None) -> DataFrame:
    """(a, b, score), a < b: names that share a band, with the exact Jaccard similarity of their shingles, ``least`` or more.

    Above 0 pairs are looked for by rare shingles, and bands only held against what is alike: bands of names from few
    words are shared by very many. With a lineage names are signed once and written.
    """
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    signatures = signed(names).where(F.size("bands") > 0).select("uuid", hashes("shingles").alias("shingles"), hashes("bands").alias("bands"))
    signatures = lineage.cut(signatures) if lineage else signatures
    if least > 0:
        rows = _rarest(signatures, "uuid", _shingle_counts(signatures), least).withColumnRenamed("t", "at")
    else:
        rows = signatures.select("uuid", F.size("shingles").alias("n"), F.explode("bands").alias("at"))
    rows = rows.withColumnRenamed("uuid", "a")
    pairs = rows.join(rows.toDF(*("b" if c == "a" else "m" if c == "n" else c for c in rows.columns)), "at").where((F.col("a") < F.col("b")) & _near_size("n", "m", least)).select("a", "b").distinct()
    side = lambda n, s, k: signatures.select(F.col("uuid").alias(n), F.col("shingles").alias(s), F.col("bands").alias(k))
    both = pairs.join(side("a", "sa", "ka"), "a").join(side("b", "sb", "kb"), "b").withColumn("score", T.jaccard(F.col("sa"), F.col("sb")))
    return both.where((F.col("score") >= least) & F.arrays_overlap("ka", "kb")).select("a", "b", "score")


def safeguard(kind: Column, a_hints: Column, b_hints: Column, a_name: Column, b_name: Column) -> Column:
    """Reason under which two nodes of one exact name may be merged; null if they may not."""
    shared, either = F.size(F.array_intersect(a_hints, b_hints)) > 0, (F.size(a_hints) > 0) != (F.size(b_hints) > 0)
    none = (F.size(a_hints) == 0) & (F.size(b_hints) == 0)
    place = F.when(shared, "exact_geo").when(either, "exact_geo_hint_partial").when(none, "exact")
    both = a_name.isNotNull() & b_name.isNotNull()
    person = F.when(~both | (a_name == b_name), "exact")
    institution = F.when(shared, "exact_ror").when(either, "exact_ror_partial").when(both & (a_name == b_name), "exact").when(~both, "exact_institution_partial")
    return F.when(kind == "Location", place).when(kind == "People", person).when(kind == "Institution", institution).otherwise("exact")


def geo_hints(summary: Column, attributes: Column | None = None, places: Sequence[str] = GEO_HINTS) -> Column:
    """Known places among the words of a summary and, if given, the values of the place keys of a JSON text."""
    words = F.filter(F.split(F.lower(F.coalesce(summary, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    if attributes is not None:
        words = F.concat(words, F.filter(F.array(*(F.trim(F.lower(F.get_json_object(attributes, f"$.{k}"))) for k in GEO_KEYS)), lambda x: x.isNotNull()))
    return F.array_distinct(F.array_intersect(words, F.array(*map(F.lit, places))))


def ror_hints(nodes: DataFrame, index: DataFrame | None) -> DataFrame:
    """nodes with ``hints``: the ids that index(name, ror_id) knows for their names; none without an index."""
    if index is None:
        return nodes.withColumn("hints", F.array().cast("array<string>"))
    ids = index.groupBy(T.norm_exact(F.col("name")).alias("__k")).agg(F.collect_set("ror_id").alias("hints"))
    out = nodes.withColumn("__n", T.norm_exact(F.col("name"))).join(ids, F.col("__n") == F.col("__k"), "left")
    return out.withColumn("hints", F.coalesce("hints", F.array().cast("array<string>"))).drop("__n", "__k")


GUARDS = ("kind", "hints", "own")


def resolve(extracted: DataFrame, existing: DataFrame, least: float = FUZZY, by: str | None = None) -> DataFrame:
    """(uuid, canonical, reason) of extracted(uuid, name) against existing(uuid, name), of the same group ``by`` if given.

    An exact or singular key takes the smallest uuid that has it. Where both sides have the columns kind, hints and own,
    it takes the smallest that ``safeguard`` lets it have, by the reason that says; a name whose key is known but which may
    have none of its nodes stays unresolved. Names without a key, if they say enough, take the most alike existing name
    of Jaccard ``least`` or more among those in a common band, the smallest uuid on ties.
    """
    group = ["grp"] if by else []
    keys = keyed(extracted, by).select("uuid", *group, "key")
    if all(c in extracted.columns and c in existing.columns for c in GUARDS):
        theirs = existing.select(F.col("uuid").alias("canonical"), "name", F.array_sort("hints").alias("b_hints"), F.col("own").alias("b_own"))
        theirs = keyed(existing, by).select("uuid", *group, "key").join(theirs.select(F.col("canonical").alias("uuid"), "b_hints", "b_own"), "uuid")
        first = theirs.groupBy(*group, "key", "b_hints", "b_own").agg(F.min("uuid").alias("canonical"))  # alike copies of a key meet before the join
        mine = keys.join(extracted.select("uuid", "kind", "hints", "own"), "uuid").join(first, [*group, "key"])
        hits = mine.withColumn("reason", safeguard(F.col("kind"), F.col("hints"), F.col("b_hints"), F.col("own"), F.col("b_own")))
        known = hits.select("uuid").distinct()
        best = hits.where("reason is not null").groupBy("uuid").agg(F.min(F.struct("canonical", "reason")).alias("m"))
        exact = best.select("uuid", "m.canonical", "m.reason")
    else:
        first = keyed(existing, by).groupBy(*group, "key").agg(F.min("uuid").alias("canonical"))  # copies of a key meet before the join
        exact = keys.join(first, [*group, "key"]).groupBy("uuid").agg(F.min("canonical").alias("canonical")).withColumn("reason", F.lit("exact"))
        known = exact.select("uuid")
    grouped = [_group(by).alias("grp")] if by else []
    rest = extracted.select("uuid", "name", *grouped).join(known, "uuid", "left_anti")
    fuzzy = T.norm_fuzzy(F.col("name"))
    enough = lambda df: df.where(T.high_entropy(fuzzy)).select("name", T.shingles(fuzzy).alias("shingles")).where(F.size("shingles") > 0)
    left = enough(rest.select("name").distinct())
    each = existing.groupBy(*grouped, T.norm_exact(F.col("name")).alias("canonical")).agg(F.min("uuid").alias("uuid"))
    right = enough(each.select(F.col("canonical").alias("name")).distinct()).withColumnRenamed("name", "canonical")
    hashes = lambda df: df.withColumn("shingles", F.transform("shingles", lambda x: F.xxhash64(x)))
    counts = _shingle_counts(hashes(right))
    pairs = _rarest(hashes(left), "name", counts, least).join(_rarest(hashes(right), "canonical", counts, least).withColumnRenamed("n", "m"), "t")
    pairs = pairs.where(_near_size("n", "m", least)).select("name", "canonical").distinct()
    near = pairs.join(left, "name").join(right.withColumnRenamed("shingles", "theirs"), "canonical").withColumn("score", T.jaccard(F.col("shingles"), F.col("theirs")))
    near = Lineage(extracted.sparkSession).cut(near.where(F.col("score") >= least).select("name", "canonical", "score"))
    # Signatures are dear: only names that are alike by their shingles are signed.
    bands = signed(near.select("name").union(near.select("canonical")).distinct()).select("name", "bands")
    near = near.join(bands, "name").join(bands.toDF("canonical", "their_bands"), "canonical").where(F.arrays_overlap("bands", "their_bands")).select("name", "canonical", "score")
    near = near.join(rest.select("name", *group).distinct(), "name") if by else near
    near = near.join(each, [*group, "canonical"])
    best = near.groupBy("name", *group).agg(F.min_by("uuid", F.struct(-F.col("score"), "uuid")).alias("canonical"))
    return exact.select("uuid", "canonical", "reason").unionByName(rest.join(best, ["name", *group]).select("uuid", "canonical", F.lit("fuzzy").alias("reason")))


def without_known_duplicates(pairs: DataFrame, edges: DataFrame, name: str = "IS_DUPLICATE_OF") -> DataFrame:
    """pairs(source_node_uuid, target_node_uuid, ...) less those an edge of that name links already."""
    ends = ["source_node_uuid", "target_node_uuid"]
    return pairs.join(edges.where(F.col("name") == name).select(*ends), ends, "left_anti")


def matched_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(norm, count_a, count_b) of names that stand in both a(norm, count) and b(norm, count)."""
    sums = lambda df, c: df.groupBy("norm").agg(F.sum("count").alias(c))
    return sums(a, "count_a").join(sums(b, "count_b"), "norm")


def unmatched_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each norm of a(norm) that b(norm) lacks."""
    return a.select("norm").distinct().join(b.select("norm"), "norm", "left_anti")


def alike_names(names: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, score), a < b: names(name) whose padded 3-grams have that Jaccard similarity, by prefixes.

    Two such sets share one of the first n - ceil(least * n) + 1 grams of either in the order of their frequency, rare
    ones first, so only these are joined.
    """
    padded = F.concat(F.lit(" "), "name", F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))
    sets = names.select("name").distinct().where("length(name) > 0").select("name", grams.alias("g"))
    flat = sets.select("name", F.explode("g").alias("t"))
    counted = flat.join(flat.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "t")
    ordered = counted.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    ordered = ordered.select("name", F.col("o.t").alias("o")).select("name", F.col("o").alias("g"), F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.size("o") * least) + 1).cast("int")).alias("p"))
    a = ordered.select(F.col("name").alias("a"), F.col("g").alias("ga"), F.explode("p").alias("t"))
    b = ordered.select(F.col("name").alias("b"), F.col("g").alias("gb"), F.explode("p").alias("t"))
    pairs = a.join(b, "t").where("a < b").dropDuplicates(["a", "b"]).withColumn("score", T.jaccard(F.col("ga"), F.col("gb")))
    return pairs.where(F.col("score") >= least).select("a", "b", "score")


def duplicate_candidates(edges: DataFrame, embedding: str, least: float = 0.6) -> DataFrame:
    """(a, b), a < b: edges of the same ends whose facts share a word or are alike."""
    ends = ["source_node_uuid", "target_node_uuid"]
    side = lambda n, x, f: edges.select(*ends, F.col("uuid").alias(n), F.col(embedding).cast("array<double>").alias(x), F.split("fact", " +").alias(f))
    pairs = side("a", "x", "fa").join(side("b", "y", "fb"), ends)
    return pairs.where((F.col("a") < F.col("b")) & (F.arrays_overlap("fa", "fb") | (V.cosine(F.col("x"), F.col("y")) >= least))).select("a", "b")


def dedupe_batch(names: DataFrame, lineage: Lineage, least: float = FUZZY, by: str | None = None, order: str | None = None) -> DataFrame:
    """(uuid, canonical) within one batch names(uuid, name): exact keys and alike names, of the same group ``by`` if given,
    make components. Canonical is the first of a component by the column ``order``, or the smallest uuid without one."""
    group = ["grp"] if by else []
    grouped = [_group(by).alias("grp")] if by else []
    exactly = T.norm_exact(F.col("name")).alias("name")
    # Copies of a name have all keys in common, so one row of each is linked and the others follow it.
    first = lineage.cut(names.where("name is not null").groupBy(*grouped, exactly).agg(F.min("uuid").alias("uuid")))
    keys = keyed(first, "grp" if by else None)
    heads = keys.groupBy(*group, "key").agg(F.min("uuid").alias("b"))
    exact = keys.join(heads, [*group, "key"]).where("uuid <> b").select(F.col("uuid").alias("a"), "b")
    if by:  # names are compared once, whatever the number of groups that have them
        alike = jaccard_pairs(first.select(F.col("name").alias("uuid"), "name").distinct(), least, lineage)
        side = lambda c: first.select("grp", F.col("name").alias(c), F.col("uuid").alias(f"{c}_uuid"))
        alike = alike.join(side("a"), "a").join(side("b"), ["grp", "b"]).select(F.least("a_uuid", "b_uuid").alias("a"), F.greatest("a_uuid", "b_uuid").alias("b"))
    else:
        alike = jaccard_pairs(first, least, lineage).select("a", "b")
    copies = names.select("uuid", *grouped, exactly.alias("__n"))
    torn = copies.join(copies.groupBy("uuid").agg(F.count_distinct("__n").alias("k")).where("k > 1").select("uuid"), "uuid", "left_semi")  # a uuid of several names links them
    torn = torn.join(first.withColumnsRenamed({"uuid": "b", "name": "__n"}), [*group, "__n"]).select(F.col("uuid").alias("a"), "b")
    heads = first.join(graph.components(exact.union(alike).union(torn).distinct(), lineage), "uuid", "left").select(*group, F.col("name").alias("__n"), F.coalesce("canonical", "uuid").alias("canonical"))
    found = copies.join(heads, [*group, "__n"], "left").select("uuid", F.coalesce("canonical", "uuid").alias("canonical"))
    if order:
        place = names.select("uuid", F.struct(F.col(order).alias("at"), F.col("uuid").alias("first")).alias("place"))
        heads = found.join(place, "uuid").groupBy("canonical").agg(F.min("place").alias("place"))
        found = found.join(heads, "canonical").select("uuid", F.col("place.first").alias("canonical"))
    return found


def guard_replies(replies: DataFrame, extracted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, canonical) of a model's replies(ord, id, duplicate_idx): unknown and repeated ids are dropped (first wins);
    an index out of range, or -1, means the node itself. Candidates(idx, uuid) are those of all, or those of each id if
    they have one."""
    first = replies.groupBy("id").agg(F.min_by("duplicate_idx", "ord").alias("duplicate_idx"))
    known = first.join(extracted.select("id", "uuid"), "id")
    own = ["id"] if "id" in candidates.columns else []
    out = known.join(candidates.select(*own, F.col("idx").alias("duplicate_idx"), F.col("uuid").alias("candidate")), [*own, "duplicate_idx"], "left")
    return out.select("id", F.coalesce("candidate", "uuid").alias("canonical"))


def union_candidates(found: DataFrame, override: DataFrame) -> DataFrame:
    """Both lists (uuid, ord), each uuid once at its first place; found ones come before the override."""
    both = found.select("uuid", F.lit(0).alias("list"), "ord").unionByName(override.select("uuid", F.lit(1).alias("list"), "ord"))
    return both.groupBy("uuid").agg(F.min(F.struct("list", "ord")).alias("at")).select("uuid", F.col("at.list").alias("list"), F.col("at.ord").alias("ord"))


def allowed_edge_types(edges: DataFrame, nodes: DataFrame, type_map: DataFrame, custom: list[str]) -> DataFrame:
    """(uuid, name): names of custom types stay only where the type map allows them between labels of the two ends."""
    labels = nodes.select("uuid", F.explode(F.array_union("labels", F.array(F.lit("Entity")))).alias("label"))
    ends = edges.join(labels.select(F.col("uuid").alias("source_node_uuid"), F.col("label").alias("src_label")), "source_node_uuid").join(
        labels.select(F.col("uuid").alias("target_node_uuid"), F.col("label").alias("dst_label")), "target_node_uuid"
    )
    fits = ends.join(type_map, ["src_label", "dst_label"]).where("name = edge_type").select("uuid").distinct().withColumn("fits", F.lit(True))
    out = edges.join(fits, "uuid", "left")
    return out.select("uuid", F.when(F.col("name").isin(*custom) & F.col("fits").isNull(), "RELATES_TO").otherwise(F.col("name")).alias("name"))


def fact_duplicates(edges: DataFrame, embedding: str, least: float = 0.9, lineage: Lineage | None = None, rounds: int = 1000) -> DataFrame:
    """(a, b): greedy pairs of one pair of ends by falling cosine of facts, then by uuids, each edge in one pair at most.

    Likely pairs come from products of bounded chunks, so a hub pair of ends is many tasks. A pair that is the first one
    for both its edges is taken by the greedy order, whatever comes before it; so all such pairs are taken at once, pairs
    that meet them go, and the rest is looked at again.
    """
    lineage = lineage or Lineage(edges.sparkSession)
    rows = edges.select("uuid", F.to_json(F.array("source_node_uuid", "target_node_uuid")).alias("grp"), F.col(embedding).cast("array<double>").alias("v"))
    met = nearest(rows, rows, least - 2.0**-40, None, lineage).where(F.col("query_uuid") < F.col("uuid"))
    left = lineage.cut(met.select(F.col("query_uuid").alias("a"), F.col("uuid").alias("b"), (-F.col("cosine")).alias("far")))
    taken = []
    for _ in range(rounds):
        ends = left.select(F.col("a").alias("e"), "far", "a", "b").unionByName(left.select(F.col("b").alias("e"), "far", "a", "b"))
        first = ends.groupBy("e").agg(F.min(F.struct("far", "a", "b")).alias("m"))
        both = first.groupBy("m.a", "m.b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")
        both = lineage.cut(both)
        if not both.take(1):
            break
        taken.append(both)
        gone = lineage.cut(both.select(F.explode(F.array("a", "b")).alias("e")))
        left = lineage.cut(left.join(gone.withColumnRenamed("e", "a"), "a", "left_anti").join(gone.withColumnRenamed("e", "b"), "b", "left_anti").select("a", "b", "far"))
    else:
        raise RuntimeError("pairs did not settle")
    return reduce(DataFrame.unionByName, taken) if taken else left.select("a", "b")
