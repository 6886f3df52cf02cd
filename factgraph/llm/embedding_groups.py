"""Operator 8: near-duplicate embeddings by exact cosine products, pruned by spherical k-means cells.

Equal vectors make one class, and one head of each is compared. Spherical k-means is fitted on a bounded sample of
heads (``SAMPLE_PER_CELL`` for each of at most ``MAX_CELLS`` cells, and at most ``FIT_BYTES``); centroids nearer to each other than ``MERGE``
become one. Every head, not only the sample, belongs to its nearest cell; small cells share a block of about BLOCK_ROWS
heads, large ones are dealt to several. A head is sent, by a shuffle, to the blocks of every cell that can hold a
partner: y of cell c is no farther from c than from the cell h of x, so x must lie within the angle of the threshold
of the half space nearer to c, or x links with nothing in c. What comes to a block is dealt in parts of about
PART_ROWS, and a task multiplies one part with one block. The products are in single precision; those within its
error bound of the threshold are made again in double precision. A product gives out the number of links of each head
and a star for each connected part, never the pairs, so a dense group costs arithmetic but no rows.

All pairs of cosine 0.9 or more are found, at any number of cells. Where the cells cannot prune (vectors that lie
evenly in all directions) the arithmetic grows with the square of the different vectors. Rows: null, empty and zero
vectors and those with null or non-finite components link with nothing; vectors of different lengths never link; equal
rows link with each other; a null vec_id links with nothing and has a null component. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, connected_components, sampled, table

MAX_CELLS = 16384
PER_CELL = 256
SAMPLE_PER_CELL = 16
MERGE = 0.7
#: Bytes of vectors that cells are fitted on.
FIT_BYTES = 64 << 20
BLOCK = 1024
#: Heads of a block, and of a part of those that are sent to it.
BLOCK_ROWS = 4096
PART_ROWS = 16384
_NONE = np.iinfo(np.int64).max


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, digest and unit vector (f64 little-endian) of usable vectors; digest and unit are null for others."""
    for batch in batches:
        digests, units = [], []
        for v in batch.column(1).to_pylist():
            a = np.array([np.nan if x is None else x for x in v or []], np.float64)
            norm = float(np.linalg.norm(a / top)) * top if len(a) and np.isfinite(a).all() and (top := float(np.abs(a).max())) > 0 else 0.0
            if norm > 0 and np.isfinite(norm):
                digests.append(xxhash.xxh3_128_digest((a + 0.0).tobytes()))
                units.append((a / norm).tobytes())
            else:
                digests.append(None)
                units.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "digest", "unit"])


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means, no two of them nearer than MERGE."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        live = norm > 1e-12
        centres[live] = sums[live] / norm[live, None]
    kept, n = np.empty_like(centres), 0
    for c in centres:
        if not n or float((kept[:n] @ c).max()) < MERGE:
            kept[n] = c
            n += 1
    return kept[:n]


def _vectors(units: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors by number of components."""
    raw = units.to_pylist()
    by_size: dict[int, list[int]] = {}
    for i, u in enumerate(raw):
        by_size.setdefault(len(u) // 8, []).append(i)
    return {size: (np.array(places), np.frombuffer(b"".join(raw[i] for i in places), np.float64).reshape(-1, size)) for size, places in by_size.items()}


def _assigned(centres: Broadcast):
    """head, rows, unit and the nearest cell; cell 0 for a length the sample did not hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, size_of = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for size, (places, v) in _vectors(batch.column(1)).items():
                size_of[places] = size
                if size in centres.value:
                    c = centres.value[size]
                    cell[places] = np.concatenate([(v[a : a + BLOCK] @ c.T).argmax(axis=1) for a in range(0, len(v), BLOCK)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size_of), pa.array(cell)], names=["head", "unit", "rows", "size", "cell"])

    return run


def blocks_of_cells(counts: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first block, number of blocks) of each cell (size, cell) with so many heads: neighbouring small cells of one size
    share a block of at most ``most`` heads, a cell of more has blocks of its own."""
    out, number, held, last = {}, -1, 0, None
    for key in sorted(counts):
        n = counts[key]
        if n > most:
            out[key] = (number + 1, -(-n // most))
            number += out[key][1]
            last = None
        else:
            if last != key[0] or held + n > most:
                number, held, last = number + 1, 0, key[0]
            held += n
            out[key] = (number, 1)
    return out


def _sent(centres: Broadcast, blocks: Broadcast, least: float):
    """head, unit, rows, its own cell's blocks, and the blocks of all cells that can hold a partner of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for (size, cell), (first, n) in blocks.value.items():
            by_size.setdefault(size, []).append((cell, first, n))
        for batch in batches:
            sizes, cells = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            to: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for size, (places, v) in _vectors(batch.column(1)).items():
                cell, first, n = np.array(by_size[size]).T
                every = np.concatenate([np.arange(f, f + k) for f, k in zip(first, n, strict=True)])
                of = np.repeat(cell, n)
                for a in range(0, len(v), BLOCK):
                    part = places[a : a + BLOCK]
                    open_ = reachable(v[a : a + BLOCK], cells[part], centres.value[size], least) if size in centres.value else np.ones((len(part), int(cell.max()) + 1), bool)
                    for i, row in zip(part, open_, strict=True):
                        to[i] = np.unique(every[row[of]]).astype(np.int32)
            own = [blocks.value[k] for k in zip(sizes.tolist(), cells.tolist(), strict=True)]
            columns = [pa.array([o[0] for o in own], pa.int32()), pa.array([o[1] for o in own], pa.int32()), pa.array(to, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["head", "unit", "rows", "first", "n", "to"])

    return run


def reachable(v: np.ndarray, cell: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """For each of the vectors v, which belong to ``cell``, and each cell whether it can hold a partner."""
    own, at = np.unique(cell, return_inverse=True)
    apart = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0))
    near = v @ centres.T
    beyond = near[np.arange(len(v)), cell][:, None] - near
    return (beyond <= (np.sqrt(1 - least * least) + 1e-9) * apart[at] + 1e-9) if 0 < least <= 1 else np.ones((len(v), len(centres)), bool)


def links_between(va: np.ndarray, vb: np.ndarray, least: float, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Which products of unit vectors reach ``least``; fa and fb are va and vb in single precision."""
    product = fa @ fb.T
    error = np.float32((va.shape[1] + 4) * 2.0**-23)
    link = product >= np.float32(least) + error
    i, j = np.nonzero((product >= np.float32(least) - error) & ~link)
    for a in range(0, len(i), 1 << 16):
        x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        link[x, y] = np.einsum("ij,ij->i", va[x], vb[y]) >= least
    return link


def block_links(ha: np.ndarray, hb: np.ndarray, rb: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, links) of the left heads and (node, smallest head of its part) of all, from the links of two blocks."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    link[i, j] = False
    left, right = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    if not len(left):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    link = link[np.ix_(left, right)]
    count = link @ rb[right]
    x, y = ha[left].copy(), hb[right].copy()
    while True:
        nx = np.minimum(x, np.where(link, y[None, :], _NONE).min(axis=1))
        ny = np.minimum(y, np.where(link, nx[:, None], _NONE).min(axis=0))
        if (nx == x).all() and (ny == y).all():
            break
        x, y = nx, ny
    return ha[left], count, np.concatenate([ha[left], hb[right]]), np.concatenate([x, y])


def _multiplied(least: float):
    """(kind, a, b) of a part of heads and a block of them: kind 0, the links of a head of the part; kind 1, an edge."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            heads, others, rows = left.column("head").to_numpy(), right.column("other").to_numpy(), right.column("rows").to_numpy()
            theirs = _vectors(right.column("theirs"))
            for size, (places, va) in _vectors(left.column("unit")).items():
                if size not in theirs:
                    continue
                to, vb = theirs[size]
                ha, hb, rb, fa, fb = heads[places], others[to], rows[to], va.astype(np.float32), vb.astype(np.float32)
                for a in range(0, len(ha), BLOCK):
                    b = a + BLOCK
                    ch, cn, node, part = block_links(ha[a:b], hb, rb, links_between(va[a:b], vb, least, fa[a:b], fb))
                    edges = np.unique(np.stack([node, part], axis=1)[node != part], axis=0)
                    found += [(np.zeros(len(ch), np.int64), ch, cn), (np.ones(len(edges), np.int64), edges[:, 0], edges[:, 1])]
        return pa.table(dict(zip(("kind", "a", "b"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def embedding_groups(vectors: DataFrame, work: Workspace, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = work.keep(read.mapInArrow(_read, "vec_id long, digest binary, unit binary"), "known")
    usable = known.where("digest is not null and vec_id is not null")
    classes = work.keep(usable.groupBy("digest").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("rows"), F.min("unit").alias("unit")), "classes")
    total, size = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("unit")), F.lit(0))).first()
    cells = max(1, min(MAX_CELLS, -(-total // PER_CELL)))
    share = min(1.0, SAMPLE_PER_CELL * cells / max(1, total), FIT_BYTES / max(1, size))  # about FIT_BYTES of vectors at most
    cells = max(1, min(cells, round(share * total / SAMPLE_PER_CELL)))
    sample = classes.where(sampled(share, "head")).select("head", "unit").collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for row in sorted(sample, key=lambda r: r["head"]):
        by_size.setdefault(len(row["unit"]) // 8, []).append(np.frombuffer(row["unit"], np.float64))
    centres = {d: fit_cells(np.stack(rows), max(1, round(cells * len(rows) / len(sample)))) for d, rows in sorted(by_size.items())}
    centres = spark.sparkContext.broadcast(centres)  # at most MAX_CELLS, and one for each length
    placed = classes.select("head", "unit", "rows").mapInArrow(_assigned(centres), "head long, unit binary, rows long, size long, cell long")
    placed = work.keep(placed, "placed")
    counts = {(r["size"], r["cell"]): r["count"] for r in placed.groupBy("size", "cell").count().collect()}  # a row a cell
    blocks = spark.sparkContext.broadcast(blocks_of_cells(counts, BLOCK_ROWS))
    sent = placed.mapInArrow(_sent(centres, blocks, least), "head long, unit binary, rows long, first int, n int, to array<int>")
    sent = work.keep(sent, "sent")
    work.drop("placed")
    number = F.col("first") + F.pmod(F.xxhash64("head"), F.col("n")).cast("int")
    come = sent.select(F.explode("to").alias("block")).groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    parts = work.keep(come, "parts")  # a row a block; Spark sends it to the tasks while it is small
    left = sent.select("head", "unit", F.explode("to").alias("block")).join(parts, "block")
    left = left.select("block", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int").alias("part"), "head", "unit").groupBy("block", "part")
    right = sent.select(F.col("head").alias("other"), F.col("unit").alias("theirs"), "rows", number.alias("block")).join(parts, "block")
    right = right.select(F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "other", "theirs", "rows").groupBy("b", "p")
    found = work.keep(left.cogroup(right).applyInArrow(_multiplied(least), "kind long, a long, b long"), "found")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).withColumnRenamed("a", "head")
    parts = connected_components(found.where("kind = 1").select("a", "b"), work).withColumnRenamed("node", "head")
    heads = classes.select("digest", "head", "rows").join(links, "head", "left").join(parts, "head", "left")
    heads = heads.select("digest", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component"))
    rows = known.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    return rows.join(heads, "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op8_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), Workspace(spark, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id
"""
