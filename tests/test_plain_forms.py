"""Registered queries without SQL against plain versions, over their whole results."""

import os
import random
from collections import defaultdict

import pytest

from factgraph.operators import chunking
from factgraph.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def pieces(text, mark):
    """The text cut before every occurrence of the mark, read from left to right."""
    if not mark:
        return list(text)
    cuts, at = [0], text.find(mark)
    while at >= 0:
        cuts.append(at)
        at = text.find(mark, at + len(mark))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]


def windows(parts, size, overlap):
    total = [0]
    for p in parts:
        total.append(total[-1] + len(p))
    out, lo = [], 0
    while lo < len(parts):
        hi = max([lo + 1, *(h for h in range(lo, len(parts) + 1) if total[h] - total[lo] <= size)])
        out.append("".join(parts[lo:hi]).strip())
        if hi == len(parts):
            break
        lo = next(x for x in range(lo + 1, hi + 1) if x == hi or (total[hi] - total[x] <= overlap and total[hi + 1] - total[x] <= size))
    return [x for x in out if x]


def chunks(text, size, overlap, marks):
    while marks[0] and marks[0] not in text:
        marks = marks[1:]
    out, short = [], []
    for p in [*pieces(text, marks[0]), None]:
        if p is not None and len(p) <= size:
            short.append(p)
            continue
        out += windows(short, size, overlap)
        short = []
        if p is not None:
            out += chunks(p, size, overlap, marks[1:])
    return out


def packed(text, most):
    parts = []
    for paragraph in text.split("\n\n"):
        while len(paragraph.encode()) > most:
            fits = max(i for i in range(len(paragraph) + 1) if len(paragraph[:i].encode()) <= most)
            blank = paragraph.rfind(" ", 0, fits)
            cut = blank if blank > 0 else fits
            parts.append(paragraph[:cut].rstrip())
            paragraph = paragraph[cut:].lstrip()
        if paragraph:
            parts.append(paragraph)
    out = []
    for p in filter(None, parts):
        if out and len(f"{out[-1]}\n\n{p}".encode()) <= most:
            out[-1] += f"\n\n{p}"
        else:
            out.append(p)
    return out


def of_documents(spark, query, plain):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.position, r.chunk) for r in QUERIES[query](spark, SF).collect())
    assert got == sorted((r.doc_id, i, c) for r in texts for i, c in enumerate(plain(r.text or "")))


def test_chunks_of_documents(spark):
    of_documents(spark, "chunk_documents", lambda t: chunks(t, 1000, 150, ["\n\n", "\n", ". ", " ", ""]))


def test_packs_of_documents(spark):
    of_documents(spark, "pack_paragraphs", lambda t: packed(t, 100_000))


def test_communities_of_customers(spark):
    weight = defaultdict(lambda: defaultdict(int))
    for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        a, b = f"c{r.o_custkey}", f"c{(r.o_custkey * 3 + r.o_orderkey) % 1500}"
        if a != b:
            weight[a][b] += 1
            weight[b][a] += 1
    now, before, seen = {n: n for n in weight}, dict.fromkeys(weight), []
    while True:
        new = {}
        for n, near in weight.items():
            votes = defaultdict(int)
            for m, w in near.items():
                votes[now[m]] += w
            most, label = max((w, c) for c, w in votes.items())
            label = label if most > 1 else max(label, now[n])
            new[n] = min(label, now[n]) if label == before[n] != now[n] else label
        now, before = new, now
        if now == before or (now, before) in seen:
            break
        seen.append((now, before))
    assert {r.uuid: r.community for r in QUERIES["label_propagation"](spark, SF).collect()} == now


@pytest.mark.parametrize("seed", range(30))
def test_small_sizes(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["a", "é", "word ", "\n", "\n\n", ". ", "  ", "long" * 9], k=80))
    for size, overlap in ((12, 0), (30, 7), (100, 40)):
        assert chunking.split_recursive(text, size, overlap) == chunks(text, size, overlap, ["\n\n", "\n", ". ", " ", ""])
        assert chunking.pack_paragraphs(text, size) == packed(text, size)
