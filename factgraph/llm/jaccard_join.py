"""Operator 2: n-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles, each a 64-bit hash (equal texts are equal sets; two different
shingles meeting in one hash is left out of account, at 2**-64 a pair). Documents with equal sets make one class and
only one of them, the head, is compared; copies are linked through it.

Signatures. All shingles have one global order: first by tier (a fixed share of the hash range, so that counts are
needed only for the shingles a prefix can reach), then by the number of heads that hold them, then by hash. Shingles
held by at most ``RARE`` heads are indexed alone. The frequent ones fall into classes by hash and are indexed as
pairs within their class. A head of n shingles can lose at most t = n - ceil(threshold * n) of them in a link, so
its prefix is extended until sum over rare shingles of 1 plus sum over classes of (its shingles - 1) exceeds t:
two linked heads then share a rare shingle or a pair (Wang et al. 2016, "pkwise"). The number of classes follows the
size of the sets, by powers of four; a head whose smaller partners may stand in the next lower power is indexed there
too. Shingles of a single head lengthen the prefix but need no index, and most heads end there.

Verification. Within an index key, pairs pass if a histogram of their hashes allows the overlap they need, an exact
upper bound. Keys of up to ``SMALL`` heads compare all pairs; larger keys compare every head with one pivot, and
those beyond ``HELD`` do so without being gathered: the pivot is joined to their heads. Pairs
that passed are checked on the full sets and what is linked is united. Larger keys that still hold several components
are united into clusters by the heads they share, and each cluster compares its heads of different components once:
by blocks of near sizes, exact overlaps by a product over the words the blocks share, giving out a star for each
linked part and never the pairs. Connected components of all links give the groups.

Rows: null or empty texts have no shingles and link with nothing; texts of fewer words than a shingle make one
shingle; repeated rows are copies of each other; a row with null doc_id links with nothing and has a null component.
doc_id is taken to name one text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, claim, connected_components, give_back, quoted, table

RARE = 16
SMALL = 8
#: Keys of more heads than this are not gathered in one task.
HELD = 20_000
BLOCK = 512
#: So many ids of 8 bytes may be broadcast.
SENT_IDS = 2_000_000
CACHED_WORDS = 150_000

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_MIX2 = _U(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX2
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of n words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    a = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * _MIX + a[j : len(a) - k + 1 + j])
    return np.unique(h)


class Scheme:
    """The numbers that follow from words per shingle and the threshold num / den."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        share = min(1.0, 1.9 * (1 - num / den))
        self.bounds = np.array([int(min(1.0, x) * 65536) for x in (share, 1.35 * share, 2 * share)], np.uint64)

    def need(self, n: int) -> int:
        """Smallest overlap of a set of n in any link."""
        return -(-self.num * n // self.den)

    def lone(self, n: int) -> bool:
        """Whether a set of n can only be linked with its equals."""
        return self.den * n < self.num * (n + 1)

    def power(self, n: int) -> int:
        return (n.bit_length() - 1) // 2

    def powers(self, n: int) -> list[int]:
        return sorted({self.power(n), self.power(max(1, self.need(n)))})

    def classes(self, power: int) -> int:
        """So many that a set in the middle of the power has about two shingles of its prefix in each: then the pairs are fewest."""
        return max(1, round((1 - self.num / self.den) * 2 * 4**power / 1.3))

    @staticmethod
    def cells(power: int) -> int:
        return max(8, 4**power // 2)

    def tiers(self, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, tokens >> _U(48), side="right")

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Smallest overlap that links sets of a and of b shingles."""
        return -(-self.num * (a + b) // (self.num + self.den))


def _cells(tokens: np.ndarray, m: int) -> np.ndarray:
    return np.minimum(np.bincount((tokens >> _U(20) & _U(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def _describe(scheme: Scheme):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard_join", _hashes.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                size, digest, tiers, tokens, cells = [], [], [], [], []
                for text in part.column(1):
                    h = shingles(text.as_py(), scheme.n)
                    size.append(len(h))
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    if scheme.lone(len(h)):
                        tiers.append([])
                        tokens.append(b"")
                        cells.append(b"")
                        continue
                    tier = scheme.tiers(h)
                    counts = np.bincount(tier, minlength=4)
                    # every frequent class may lose its first shingle, so with this many a prefix is always complete
                    enough = len(h) - scheme.need(len(h)) + 1 + scheme.classes(scheme.power(len(h)))
                    last = min(3, int(np.searchsorted(np.cumsum(counts), enough)))
                    tiers.append(counts[: last + 1].tolist())
                    tokens.append(h[tier <= last].tobytes())
                    cells.append(_cells(h, scheme.cells(scheme.power(len(h)))).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(tiers, pa.list_(pa.int32())), pa.array(tokens, pa.binary()), pa.array(cells, pa.binary())],
                    names=["doc_id", "n", "digest", "tiers", "tokens", "cells"],
                )
        give_back()

    return run


def _token_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            ids = np.repeat(np.array(part.column(0).to_pylist(), np.int64), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)), pa.array(ids)], names=["token", "doc_id"])


def signature_keys(scheme: Scheme, n: int, tiers: list[int], tokens: np.ndarray, counts: np.ndarray, power: int) -> np.ndarray:
    """Index keys of a set of n shingles among the sets of 4**power or more; tokens are those that other heads hold too."""
    tokens, first = np.unique(tokens, return_index=True)
    counts = counts[first]
    tier = scheme.tiers(tokens)
    order = np.lexsort((tokens, counts, tier))
    tokens, counts, tier = tokens[order], counts[order], tier[order]
    alone = np.cumsum(np.array(tiers) - np.bincount(tier, minlength=len(tiers))[: len(tiers)])
    rare = counts <= RARE
    group = np.where(rare, -1, (tokens % _U(scheme.classes(power))).astype(np.int64))
    gain = np.ones(len(tokens), np.int64)
    if not rare.all():
        at = np.flatnonzero(~rare)
        gain[at[np.unique(group[at], return_index=True)[1]]] = 0
    reached = np.cumsum(gain) - gain + alone[tier]  # before the shingle itself
    need = n - scheme.need(n) + 1
    full = np.flatnonzero(reached >= need)
    end = int(full[0]) if len(full) else len(tokens)
    salt = _U(power + 1)
    keys = [_mix(tokens[:end][rare[:end]] + salt)]
    for g in np.unique(group[:end][~rare[:end]]).tolist():
        mine = np.sort(tokens[:end][group[:end] == g])
        i, j = np.triu_indices(len(mine), 1)
        keys.append(_mix(_mix(mine[i] + salt) * _MIX + mine[j]))
    return np.concatenate(keys)


def _index_rows(scheme: Scheme):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keys, ids, sizes, cells = [], [], [], []
                for doc, n, tiers, cell, tokens, counts in zip(*(part.column(i) for i in range(6)), strict=True):
                    n, tiers = n.as_py(), tiers.as_py()
                    tokens = tokens.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    counts = counts.values.to_numpy(zero_copy_only=False)
                    own = np.frombuffer(cell.as_py(), np.uint8)
                    for power in scheme.powers(n):
                        got = signature_keys(scheme, n, tiers, tokens, counts, power)
                        m = scheme.cells(power)
                        fold = own.reshape(-1, m).astype(np.int64).sum(axis=0) if len(own) >= m else own
                        fold = np.minimum(fold, 255).astype(np.uint8).tobytes()
                        keys.append(got)
                        ids += [doc.as_py()] * len(got)
                        sizes += [n] * len(got)
                        cells += [fold] * len(got)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())], names=["key", "doc_id", "n", "cells"])

    return run


class _Held:
    """Rows of one key as arrays."""

    def __init__(self, ids: list[int], sizes: list[int], cells: list[bytes]):
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        m = max(map(len, cells), default=0)
        self.cells = np.stack([np.frombuffer(c.ljust(m, b"\0"), np.uint8) for c in cells]) if cells else np.zeros((0, 8), np.uint8)
        self.rest = self.sizes - self.cells.sum(axis=1, dtype=np.int64)

    def may_link(self, scheme: Scheme, one: int, others: np.ndarray, them: _Held) -> np.ndarray:
        """Those of ``others`` (places in them) whose histogram allows a link with place ``one``."""
        need = scheme.overlap(self.sizes[one], them.sizes[others])
        others = others[(need <= np.minimum(self.sizes[one], them.sizes[others])) & (self.ids[one] != them.ids[others])]
        if not len(others):
            return others
        most = np.minimum(self.cells[one], them.cells[others]).sum(axis=1, dtype=np.int64) + np.minimum(self.rest[one], them.rest[others])
        return others[most >= scheme.overlap(self.sizes[one], them.sizes[others])]


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows that are equal in the first ``keys`` columns, of sorted batches; each as the lists of the others."""
    now, held = None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        heads = list(zip(*columns[:keys], strict=True))
        marks = [i for i in range(len(heads)) if i == 0 or heads[i] != heads[i - 1]] + [len(heads)]
        for a, b in zip(marks, marks[1:], strict=False):
            if heads[a] == now:
                for x, c in zip(held, columns[keys:], strict=True):
                    x += c[a:b]
            else:
                if now is not None:
                    yield now, held
                now, held = heads[a], [c[a:b] for c in columns[keys:]]
    if now is not None:
        yield now, held


class _Pairs:
    """Distinct pairs of a task, given out in batches."""

    def __init__(self):
        self.kind, self.a, self.b = [], [], []
        self.size = 0

    def add(self, kind: int, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.kind.append(np.full(len(a), kind, np.int64))
            self.a.append(np.minimum(a, b) if kind == 0 else a)
            self.b.append(np.maximum(a, b) if kind == 0 else b)
            self.size += len(a)

    def out(self) -> pa.RecordBatch:
        rows = np.unique(np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.kind, self.a, self.b)]), axis=1)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["kind", "a", "b"])


def _near_pivot(scheme: Scheme):
    """From rows (key, doc_id, n, cells) sorted by key and doc_id: kind 0 pairs to verify, kind 1 keys (a) of more than SMALL heads and their number (b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()
        for (key,), (ids, sizes, cells) in _grouped(batches, 1):
            if len(ids) < 2:
                continue
            held = _Held(ids, sizes, cells)
            if len(ids) > SMALL:
                pairs.add(1, np.array([key], np.int64), np.array([len(ids)], np.int64))
            for i in range(len(ids) - 1 if len(ids) <= SMALL else 1):
                far = held.may_link(scheme, i, np.arange(i + 1, len(ids)), held)
                pairs.add(0, np.full(len(far), held.ids[i]), held.ids[far])
            if pairs.size > 200_000:
                yield pairs.out()
        yield pairs.out()

    return run


def _with_pivot(scheme: Scheme):
    """From rows (pivot, its n and cells, doc_id, n, cells): kind 0 pairs to verify."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            pairs = _Pairs()
            marks = [i for i in range(batch.num_rows) if i == 0 or columns[0][i] != columns[0][i - 1] or columns[2][i] != columns[2][i - 1]] + [batch.num_rows]
            for a, b in zip(marks, marks[1:], strict=False):  # runs of one pivot
                held = _Held([columns[0][a], *columns[3][a:b]], [columns[1][a], *columns[4][a:b]], [columns[2][a], *columns[5][a:b]])
                far = held.may_link(scheme, 0, np.arange(1, len(held.ids)), held)
                pairs.add(0, np.full(len(far), held.ids[0]), held.ids[far])
            yield pairs.out()

    return run


def overlaps(one: list[np.ndarray], two: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products over at most ``width`` shared elements at a time."""
    flat, other = np.concatenate(one), np.concatenate(two)
    shared = np.intersect1d(flat, other)
    total = np.zeros((len(one), len(two)), np.float64)
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (one, two)]
    for a in range(0, len(shared), width):
        part = shared[a : a + width]
        sides = []
        for values, row, count in ((flat, rows[0], len(one)), (other, rows[1], len(two))):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            side = np.zeros((count, len(part)), np.float32)
            side[row[hit], at[hit]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def linked_parts(scheme: Scheme, one: tuple, two: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(head, smallest head of its part) of the links between two blocks (heads, components, sets), components apart."""
    (ha, ca, sa), (hb, cb, sb) = one, two
    na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
    both = overlaps(sa, sb)
    link = (scheme.den * both >= scheme.num * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :])
    x, y = ha.copy(), hb.copy()
    none = np.iinfo(np.int64).max
    while True:
        nx = np.minimum(x, np.where(link, y[None, :], none).min(axis=1))
        ny = np.minimum(y, np.where(link, nx[:, None], none).min(axis=0))
        if (nx == x).all() and (ny == y).all():
            break
        x, y = nx, ny
    node, part = (ha, x) if same else (np.concatenate([ha, hb]), np.concatenate([x, y]))
    return node[node != part], part[node != part]


def _across(scheme: Scheme):
    """From rows (cluster, left, right, block, doc_id, component, set), sorted by the first three: links as stars (a, b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, left, right), (block, ids, parts, sets) in _grouped(batches, 3):
            block, ids, parts = np.array(block), np.array(ids, np.int64), np.array(parts, np.int64)
            sides = []
            for side in (left, right):
                at = np.flatnonzero(block == side)
                sides.append((ids[at], parts[at], [np.frombuffer(sets[i], np.uint64) for i in at.tolist()]))
            if len(sides[0][0]) and len(sides[1][0]):
                a, b = linked_parts(scheme, sides[0], sides[1], left == right)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _compared(members: DataFrame, docs: DataFrame, scheme: Scheme, work: Workspace) -> DataFrame:
    """Links (a, b) between members(cluster, doc_id, n, component) of one cluster and different components."""
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(scheme.den / scheme.num)) * (1 + 1e-9))).cast("int")  # linked sets stand in one band or in neighbouring ones
    members = members.withColumn("band", band)
    sizes = members.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    around = sizes.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    around = around.select("cluster", (F.col("band") + F.col("step")).alias("band"), F.col("band").alias("other_band"), F.col("blocks").alias("other_blocks"))
    rows = members.join(sizes, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    own = F.shiftleft(F.col("band").cast("long"), 32) + F.col("block")
    rows = rows.join(around, ["cluster", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    other = F.shiftleft(F.col("other_band").cast("long"), 32) + F.col("other")
    rows = rows.select("cluster", F.least(own, other).alias("left"), F.greatest(own, other).alias("right"), own.alias("block"), "doc_id", "component")
    rows = rows.join(_sets_of(members.select("doc_id"), docs, scheme, work, "cluster-sets"), "doc_id").select("cluster", "left", "right", "block", "doc_id", "component", "set")
    return rows.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right").mapInArrow(_across(scheme), "a long, b long")


def _sets(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), n).tobytes() for t in part.column(1)], pa.binary())], names=["doc_id", "set"])

    return run


def _linked(scheme: Scheme):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(scheme.den * both >= scheme.num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, scheme: Scheme, work: Workspace, name: str) -> DataFrame:
    """doc_id, set of those documents. Up to SENT_IDS ids go to the texts; more of them, and the texts are shuffled."""
    asked = work.keep(ids.distinct(), f"{name}-ids")
    asked = F.broadcast(asked) if asked.count() <= SENT_IDS else asked
    return work.keep(docs.join(asked, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(scheme.n), "doc_id long, set binary"), name)


def _verified(pairs: DataFrame, docs: DataFrame, scheme: Scheme, work: Workspace) -> DataFrame:
    """Those of pairs(a, b) that are linked, on the full sets of both."""
    pairs = work.keep(pairs.select("a", "b").distinct(), "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, scheme, work, "sets")
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    out = work.keep(two.mapInArrow(_linked(scheme), "a long, b long").distinct(), "links")
    work.drop("sets")
    work.drop("pairs")
    return out


def jaccard_groups(docs: DataFrame, work: Workspace, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    scheme = Scheme(words, num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = work.keep(docs.mapInArrow(_describe(scheme), "doc_id long, n long, digest binary, tiers array<int>, tokens binary, cells binary"), "described")
    heads = work.keep(known.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n_rows")), "heads")
    lead = known.join(heads.select("digest", F.col("head").alias("doc_id")), ["digest", "doc_id"], "left_semi").where("size(tiers) > 0")
    lead = work.keep(lead.select("doc_id", "n", "tiers", "tokens", "cells"), "lead")
    known = work.keep(known.select("doc_id", "n", "digest"), "known")
    work.drop("described")

    tokens = lead.select("doc_id", "tokens").mapInArrow(_token_rows, "token long, doc_id long")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("heads")).where("heads > 1")
    shared = tokens.join(counts, "token").groupBy("doc_id").agg(F.collect_list("token").alias("held"), F.collect_list("heads").alias("heads"))
    asked = lead.select("doc_id", "n", "tiers", "cells").join(shared, "doc_id").select("doc_id", "n", "tiers", "cells", "held", "heads")
    index = work.keep(asked.mapInArrow(_index_rows(scheme), "key long, doc_id long, n long, cells binary"), "index")
    work.drop("lead")

    heavy = work.keep(index.groupBy("key").agg(F.count(F.lit(1)).alias("heads"), F.min("doc_id").alias("pivot")).where(F.col("heads") > HELD), "heavy")
    light = index
    if not heavy.isEmpty():
        light = index.join(heavy.select("key"), "key", "left_anti")
    near = light.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_near_pivot(scheme), "kind long, a long, b long")
    if light is not index:  # each row meets its key's pivot where it is: such a key never stands in one task
        pivots = index.join(heavy, "key").where("doc_id = pivot").select("key", "pivot", F.col("n").alias("p_n"), F.col("cells").alias("p_cells")).dropDuplicates(["key"])
        rows = index.join(pivots, "key").where("doc_id <> pivot").select("pivot", "p_n", "p_cells", "doc_id", "n", "cells")
        near = near.union(rows.mapInArrow(_with_pivot(scheme), "kind long, a long, b long").distinct()).union(heavy.select(F.lit(1).cast("long"), "key", "heads"))
    near = work.keep(near, "near")
    links = _verified(near.where("kind = 0"), docs, scheme, work)
    parts = connected_components(links, work, "first")
    large = near.where("kind = 1").select(F.col("a").alias("key"))
    if not large.isEmpty():
        rows = index.select("key", "doc_id", "n").join(large, "key").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.min("doc_id").alias("pivot")).where("l <> h").select("key", "pivot")
        rows = work.keep(rows.join(mixed, "key"), "mixed")
        clusters = connected_components(rows.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")), work, "cluster")
        members = rows.select("doc_id", "n", "component").distinct().join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
        across = _compared(work.keep(members, "members"), docs, scheme, work)
        links = links.union(work.keep(across.distinct(), "across"))
        parts = connected_components(links, work, "second")
    work.drop("index")
    heads = heads.join(parts.withColumnRenamed("node", "head"), "head", "left").select("digest", F.coalesce("component", "head").alias("component"))
    found = known.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return found.join(heads, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, work: Workspace, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs less those in whose group a smaller doc_id stands; of repeated doc_ids each row stays."""
    groups = jaccard_groups(docs, work, words, num, den)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), Workspace(spark, "jaccard"), words=3, num=90, den=100)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN list_aggregate(w, 'string_agg', ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE w <> [''])),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
