"""Operator 10: benchmark decontamination with a generalised suffix automaton.

The items' words, as numbers, go into one generalised suffix automaton (Blumer et al. 1985). Streaming a document's
words through it keeps, at every word, the longest suffix read so far that occurs in some item; a length of
``window`` or more means that the last ``window`` words are a window of an item. Items shorter than the window are
one window each. ``ITEMS_BYTES`` bounds the item text of one automaton, which tasks build from that text and hold;
larger benchmarks become several automata, which read those runs of the documents' words that may hold a window of
theirs (see ``contamination``).

Rows: null or empty texts have no words and no hits; null items have no window; an item with a null item_id hits words
but is named by nothing. Repeated items count once per item_id, repeated documents are documents of their own, and
spans that overlap or touch are one. Empty tables give no rows and no hits. Other columns of the input are ignored
unless ``keep`` asks for them; a kept column that bears a result's name gives way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import windows
from factgraph.llm.common import Workspace, claim, kept_beside, mapped, named_apart, quoted, table

WINDOW = 13
#: Item text of one automaton, which takes some hundred times as much memory.
ITEMS_BYTES = 1 << 20
#: Words of documents, in bytes, that one task holds against a part of a larger benchmark.
RUNS_BYTES = 32 << 20

#: Bytes that separate words become blanks, A-Z become a-z; digits, letters and all bytes of other characters stay.
_WORDS = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def plain(text: str | None) -> bytes:
    """The words of a text in small letters with blanks between them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)


def words(text: str | None) -> list[bytes]:
    return plain(text).split()


class SuffixAutomaton:
    """All substrings of several word sequences, with the items in which the substrings of a state occur."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        self.short: dict[tuple[int, int], set[int]] = {}
        self.pairs: set[int] = set()
        self.shortest = window
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text]
            self.pairs.update((a << 32) | b for a, b in zip(ids, ids[1:], strict=False))
            self._add(ids, k)
            if 0 < len(ids) < window:
                self.shortest = min(self.shortest, len(ids))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= window:  # items are asked for at the shortest such suffix
                self.own[self.link[state]] |= self.own[state]
            elif self.length[state] < window:
                self.own[state] = set()
        for k, (_, text) in enumerate(items):  # the state of each short item, by the item's length
            if 0 < len(text) < window:
                state = 0
                for w in text:
                    state = self.next[state][self.vocabulary[w]]
                self.short.setdefault((state, len(text)), set()).add(k)
        self.short_lengths = sorted({n for _, n in self.short})
        self.pair_keys = np.array(sorted(self.pairs), dtype=np.uint64)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.own.append(set())
        return len(self.length) - 1

    def _split(self, last: int, word: int, at: int) -> int:
        """A copy of state ``at`` for the strings that reach it from ``last`` or shorter."""
        copy = self._state(self.length[last] + 1)
        self.next[copy] = dict(self.next[at])
        self.link[copy] = self.link[at]
        self.link[at] = copy
        while last >= 0 and self.next[last].get(word) == at:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def _add(self, ids: list[int], item: int) -> None:
        last = 0
        for word in ids:
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    to = self.next[p][word]
                    self.link[new] = to if self.length[to] == self.length[p] + 1 else self._split(p, word, to)
                last = new
            self.own[last].add(item)

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state): after each word the longest suffix that occurs in an item."""
        state, length, follow, link, size = 0, 0, self.next, self.link, self.length
        for end, word in enumerate(ids):
            while state and word not in follow[state]:
                state = link[state]
                length = size[state]
            if word in follow[state]:
                state, length = follow[state][word], length + 1
            yield end, length, state

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of hit words, apart and in order, and the items with windows there.

        Only runs of words each neighbouring pair of which stands in some item can hold a match of two words or
        more, so the automaton reads just the runs long enough for the shortest window.
        """
        get = self.vocabulary.get
        ids = [get(w, 0) for w in text]
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.shortest < 2 or len(ids) < 2:
            runs = [(0, len(ids))] if len(ids) >= self.shortest else []
        else:
            a = np.array(ids, dtype=np.uint64)
            key = (a[:-1] << np.uint64(32)) | a[1:]
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            good = np.concatenate([[False], self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(len(key), bool), [False]])
            edges = np.flatnonzero(good[1:] != good[:-1])
            runs = [(x, y + 1) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if y + 1 - x >= self.shortest]
        for begin, stop in runs:
            for end, length, state in self.matches(ids[begin:stop]):
                found = 0
                if length >= self.window:
                    at = state
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    items |= self.own[at]
                    found = self.window
                if self.short_lengths and length >= self.short_lengths[0]:
                    at = state
                    while at > 0:
                        low = self.length[self.link[at]]
                        for n in self.short_lengths:
                            if low < n <= min(length, self.length[at]) and (at, n) in self.short:
                                items |= self.short[at, n]
                                found = max(found, n)
                        at = self.link[at]
                if found:
                    to, since = begin + end + 1, begin + end + 1 - found
                    while hits and hits[-1][1] >= since:
                        since = min(since, hits.pop()[0])
                    hits.append((since, to))
        return hits, items


def item_groups(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[str | None, str]]]:
    """The items (id as string, text) of a benchmark(item_id, text) in groups of at most ``most`` characters of text, or of one item."""
    most = ITEMS_BYTES if most is None else most
    group, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        size += len(text)
        if text:
            group.append((row["item_id"], text))
    if group:
        yield group


_machines: dict[str, SuffixAutomaton] = {}


def _machine(key: str, items: list[tuple[str | None, str]], window: int) -> SuffixAutomaton:
    """The automaton of a group, built once in each worker, which keeps one."""
    if key not in _machines:
        _machines.clear()
        _machines[key] = SuffixAutomaton([(name, words(text)) for name, text in items], window)
    return _machines[key]


RESULTS = ("n_words", "n_hit", "hit_spans", "hit_items")


def _scan(docs: DataFrame, keep: list[str], group: list, window: int, names: tuple[str, ...]) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(group)  # at most ITEMS_BYTES of text
    key = uuid.uuid4().hex

    def compute(texts: list[str | None]) -> list[list]:
        claim("decontaminate", _machines.clear)
        machine = _machine(key, known.value, window)
        totals, spans, items = [], [], []
        for text in texts:
            got = words(text)
            marks, which = machine.scan(got)
            totals.append(len(got))
            spans.append([list(m) for m in marks])
            items.append(sorted({machine.names[k] for k in which} - {None}))
        return [totals, [sum(b - a for a, b in s) for s in spans], spans, items]

    kinds = zip(names, ("long", "long", "array<array<int>>", "array<string>"), strict=True)
    return mapped(docs, keep, "text", ", ".join(f"`{n}` {k}" for n, k in kinds), compute, "decontaminate")


def _joined_spans(spans: Column) -> Column:
    """Spans of several groups as spans apart and in order."""
    start = F.array().cast("array<array<int>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (F.try_element_at(last, F.lit(2)) >= span[0])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(F.flatten(spans)), start, add)


def grouped_items(benchmark: DataFrame, window: int) -> DataFrame:
    """(part, item, words) of the items that have words, in parts of at most ITEMS_BYTES bytes of words: tasks put the
    rows of a range of lengths into parts one after another, so short items stand together. An item longer than that is
    cut into stretches that share all but one word of a window, which together have exactly its windows."""
    most = ITEMS_BYTES
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0).distinct()
    ranges = max(1, min(1000, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (8 * most)))

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            parts, names, texts = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = b" ".join(words(text))
                starts, ends = windows.bounds(flat)
                for a, b in windows.stretches(starts, ends, most, window):
                    piece = flat[starts[a] : ends[b - 1]]
                    if held and held + len(piece) > most:
                        part, held = part + 1, 0
                    held += len(piece)
                    parts.append(part)
                    names.append(name)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["part", "item", "words"])

    return rows.repartitionByRange(int(ranges), F.length("text"), "item", "text").mapInArrow(put, "part long, item string, words binary")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(h, n, part): hash and length in words of every different window of each part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts, ends = windows.bounds(text)
                n = min(window, len(starts))
                h = np.unique(windows.hashes(text, starts, ends, n))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), n, np.int32)), pa.array(np.full(len(h), part, np.int64))], names=["h", "n", "part"])

    return items.select("part", "words").mapInArrow(run, "h long, n int, part long").distinct()


def _candidates(docs: DataFrame, keep: list[str], known: DataFrame, window: int) -> DataFrame:
    """``keep``, n_words and the runs of words whose windows may be among known(h, n, part)."""
    sizes = known.groupBy("n").agg(F.count(F.lit(1)).alias("count")).collect()  # one row for each length up to the window
    lengths = sorted(r["n"] for r in sizes)
    bitmap = docs.sparkSession.sparkContext.broadcast(windows.Bitmap(known.select("h"), sum(r["count"] for r in sizes)))

    def compute(texts: list[str | None]) -> list[list]:
        claim("decontaminate", windows.clear)
        totals, runs = [], []
        for text in texts:
            n, found = windows.candidate_runs(b" ".join(words(text)), lengths, window, bitmap.value)
            totals.append(n)
            runs.append([{"begin": a, "words": w, "marks": m} for a, w, m in found])
        return [totals, runs]

    return mapped(docs, keep, "text", "n_words long, runs array<struct<begin:int,words:binary,marks:array<long>>>", compute, "decontaminate")


def _run_hits(runs: DataFrame, known: DataFrame, items: DataFrame, window: int, work: Workspace) -> DataFrame:
    """(key, hit_spans, hit_items) of runs(key, words, marks), key by key and part by part: a run goes to the parts that
    have one of its windows, and the automaton of a part reads the runs that went there. A part with many runs is divided
    among tasks of RUNS_BYTES each, every one of which builds its automaton."""
    runs = runs.dropDuplicates(["key"])
    asked = runs.select("key", F.explode("marks").alias("h")).join(known.select("h", "part"), "h").select("key", "part").distinct()
    asked = work.keep(asked.join(runs.select("key", "words"), "key"), "asked")
    shares = asked.groupBy("part").agg(F.ceil(F.sum(F.octet_length("words")) / RUNS_BYTES).cast("int").alias("shares"))
    left = asked.join(shares, "part").select("part", F.pmod(F.xxhash64("key"), "shares").cast("int").alias("share"), "key", "words")
    right = items.join(shares, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "item", "words")

    def scan(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        machine = SuffixAutomaton([(name, text.split()) for name, text in zip(held["item"], held["words"], strict=True)], window)
        rows = []
        for key, text in zip(some["key"], some["words"], strict=True):
            spans, which = machine.scan(text.split())
            if spans:
                rows.append((key, [list(s) for s in spans], sorted({machine.names[k] for k in which if isinstance(machine.names[k], str)})))
        return pd.DataFrame(rows, columns=["key", "hit_spans", "hit_items"])

    return left.groupBy("part", "share").cogroup(right.groupBy("part", "share")).applyInPandas(scan, "key string, hit_spans array<array<int>>, hit_items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """The columns ``keep`` of docs and n_words, n_hit, hit_spans (array of from, to in words) and hit_items, or as
    ``names`` call them; a kept column that bears one of these names gives way to the result.

    n_hit counts words inside any occurrence of a window; hit_items are the item_ids, as strings in order. A benchmark
    of up to ITEMS_BYTES is one automaton, which every task holds. A larger one is worked off in one pass over the
    documents: a bitmap of the hashes of all its windows gives the runs of words that may hold a window, equal runs
    become one, and each goes to the automata of the parts of the benchmark that know one of its hashes. The number of
    jobs does not grow with the benchmark, and no task holds more than one automaton.
    """
    keep = ["doc_id"] if keep is None else keep
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    if size <= ITEMS_BYTES:
        return _scan(docs, keep, next(item_groups(benchmark), []), window, names)
    work = Workspace(docs.sparkSession, "decontamination")
    keep = kept_beside(keep, list(names))
    plain = [f"c{i}" for i in range(len(keep))]
    docs = docs.select(F.monotonically_increasing_id().alias("row"), *(quoted(c).alias(p) for c, p in zip(keep, plain, strict=True)), F.col("text").cast("string").alias("text"))
    items = work.keep(grouped_items(benchmark, window), "items")
    known = work.keep(item_windows(items, window), "windows")
    counted = work.keep(_candidates(docs, ["row", *plain], known, window), "documents")
    runs = counted.where(F.size("runs") > 0).select("row", F.explode("runs").alias("run")).select("row", F.sha2("run.words", 256).alias("key"), "run.*")
    hits = _run_hits(runs.select("key", "words", "marks"), known, items, window, work)
    placed = runs.select("row", "key", "begin").join(hits, "key").select("row", F.transform("hit_spans", lambda s: F.transform(s, lambda x: x + F.col("begin"))).alias("hit_spans"), "hit_items")
    united = placed.groupBy("row").agg(_joined_spans(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    united = counted.select("row", *plain, "n_words").join(united, "row", "left")
    spans, items = F.coalesce("hit_spans", F.array().cast("array<array<int>>")), F.coalesce("hit_items", F.array().cast("array<string>"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return united.select(*plain, "n_words", hit, spans, items).toDF(*keep, *names)


def is_contaminated(cover: int = 20, n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """Hit words make at least a ``cover``-th of all words."""
    return (quoted(n_hit) > 0) & (F.lit(cover) * quoted(n_hit) >= quoted(n_words))


def without_spans(text: str, spans: list[list[int]], longer: int = WINDOW, cover: float = 0.05) -> str:
    """text less the hit spans of ``longer`` words or more, or less all of them once they cover that share of the words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_WORDS)
    places, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    every = sum(b - a for a, b in spans) >= cover * len(places)
    out, since = [], 0
    for a, b in spans:
        if every or b - a >= longer:
            out.append(raw[since : places[a][0]])
            since = places[b - 1][1]
    return b"".join([*out, raw[since:]]).decode("utf-8", "surrogatepass")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = 20) -> DataFrame:
    """docs without the contaminated ones; the others as they were, whatever their columns are called."""
    names = tuple(named_apart(docs.columns, n) for n in RESULTS)
    found = contamination(docs, benchmark, window, [*docs.columns], names)
    return found.where(~is_contaminated(cover, names[0], names[1])).select(*map(quoted, docs.columns))


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longer: int = WINDOW, cover: float = 0.05) -> DataFrame:
    """All docs with all their columns, benchmark passages cut out of their texts."""
    names = tuple(named_apart(docs.columns, n) for n in RESULTS)
    columns = docs.columns
    place = columns.index("text")
    found = contamination(docs, benchmark, window, columns, names).select(*map(quoted, columns), quoted(names[2]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(columns)).to_pylist()
            texts = [t if t is None or not s else without_spans(t, s, longer, cover) for t, s in zip(batch.column(place).to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(columns))], names=columns)

    return found.mapInArrow(cut, docs.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM documents),
dw AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM d),
b AS (SELECT item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE w <> ['']),
win AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)),
m AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
