"""Operator 7: language identification with a byte convolutional network.

Texts become windows of WINDOW bytes (ASCII lower-cased, the last one filled up with zero bytes, which no filter
sees). Filters of several widths slide over the one-hot bytes of a window, each filter keeps its maximum, and a
softmax layer reads the maxima. The network is trained in numpy by Adam on about TRAIN_DOCS labelled documents at most,
chosen by a hash of doc_id and text, each of which lends STRETCHES windows that the tasks cut, so that a few MB reach the
driver however long the texts are; the gradient of a maximum reaches only the window position that made it. A document's
prediction is the mean of its windows' probabilities, each window weighing as many bytes as it holds.

Rows: null texts and texts without a letter are ``und`` with score 0; texts of any length are read whole. Equal texts
get equal answers, repeated rows too; of languages that tie the first in order of name wins. Without any labelled
row, and in an empty table, everything is ``und``. Rows with null doc_id or lang are not learnt from. ``tagged`` keeps
the columns asked for, less those that bear a result's name; ``determined`` keeps all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import mapped, named_apart, quoted, sampled, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
TRAIN_DOCS = 4000
#: Windows that a document lends to the training, each of 16 bytes to a whole one.
STRETCHES = 4
#: Windows that are predicted at once.
WINDOWS_AT_ONCE = 16384
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of a letter category stands in the text; fractions, circled and Roman numerals are none."""
    return any(map(str.isalpha, text or ""))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, bytes held by each)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    count = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(count * WINDOW, np.uint8)
    out[: len(raw)] = raw
    held = np.full(count, WINDOW, np.int64)
    held[-1] = len(raw) - (count - 1) * WINDOW
    return out.reshape(count, WINDOW), held


@dataclass
class ByteNetwork:
    languages: list[str]
    #: by width, (width, 256, FILTERS): what a byte at a place in the filter adds
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    _pairs: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"} | {"_pairs": []}

    def _tables(self) -> list:
        """Filters with the first two places (and the next two) summed for every pair of bytes."""
        if not self._pairs:
            for f in self.filters:
                f = f.astype(np.float32)
                parts = []
                for j in range(0, len(f) - 1, 2):
                    parts.append((j, (f[j][None, :, :] + f[j + 1][:, None, :]).reshape(65536, -1)))  # little-endian pairs
                if len(f) % 2:
                    parts.append((len(f) - 1, f[-1]))
                self._pairs.append(parts)
        return self._pairs

    def probabilities(self, data: np.ndarray, step: int = 64) -> np.ndarray:
        out = np.empty((len(data), len(self.languages)))
        for a in range(0, len(data), step):
            part = data[a : a + step]
            pair = part[:, :-1].astype(np.uint16) | (part[:, 1:].astype(np.uint16) << np.uint16(8))
            tops = []
            for width, parts in zip(WIDTHS, self._tables(), strict=True):
                places = WINDOW - width + 1
                total = None
                for j, values in parts:
                    index = (pair if len(values) == 65536 else part)[:, j : j + places]
                    got = values.take(index, axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                tops.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(tops, axis=1) + self.bias, 0)
            score = hidden @ self.dense + self.offset
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out[a : a + step] = score / score.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; of texts of any length so many windows at once as memory allows."""
        answers: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            end, count = at, 0
            while end < len(texts) and (end == at or count + len(texts[end] or "") // WINDOW < WINDOWS_AT_ONCE):
                count += len(texts[end] or "") // WINDOW + 1
                end += 1
            answers += self._predicted(texts[at:end])
            at = end
        return answers

    def _predicted(self, texts: list[str | None]) -> list[tuple[str, float]]:
        clear = [t is not None and bool(self.languages) and has_letter(t) for t in texts]
        answers: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        parts = [(i, *windows(t)) for i, (t, ok) in enumerate(zip(texts, clear, strict=True)) if ok]
        if not parts:
            return answers
        probs = self.probabilities(np.concatenate([p[1] for p in parts]))
        starts = np.cumsum([0, *(len(p[1]) for p in parts)])[:-1]
        held = np.concatenate([p[2] for p in parts]).astype(np.float64)
        mean = np.add.reduceat(probs * held[:, None], starts, axis=0) / np.add.reduceat(held, starts)[:, None]
        best = mean.argmax(axis=1)
        for (i, *_), k, row in zip(parts, best.tolist(), mean, strict=True):
            answers[i] = (self.languages[k], float(min(1.0, row[k])))
        return answers


def stretches(text: str, seed: int = 7) -> bytes:
    """STRETCHES windows of a text, drawn by its bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    rng = np.random.default_rng([seed, xxhash.xxh3_64_intdigest(raw.tobytes())])
    out = np.zeros((STRETCHES, WINDOW), np.uint8)
    for row in out:
        size = int(min(len(raw), rng.choice([16, 32, 64, 128, WINDOW, WINDOW])))
        at = int(rng.integers(0, len(raw) - size + 1))
        row[:size] = raw[at : at + size]
    return out.tobytes()


def train(lent: list[bytes], languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteNetwork:
    """Fit a network to the ``stretches`` of documents and their languages, which weigh alike."""
    rng = np.random.default_rng(seed)
    known = sorted(set(languages))
    data = np.frombuffer(b"".join(lent), np.uint8).reshape(-1, WINDOW)
    label = [known.index(k) for k in languages for _ in range(STRETCHES)]
    shape = (FILTERS * len(WIDTHS), len(known))
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = 0
    net = ByteNetwork(known, filters, np.zeros(shape[0]), rng.normal(0, 0.2, shape), np.zeros(shape[1]))
    if not len(data) or len(known) < 2:
        return net
    x, y = data, np.array(label)
    weight = len(y) / (len(known) * np.bincount(y, minlength=len(known)))
    params = [*net.filters, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            pick = order[a : a + batch]
            part, want = x[pick], y[pick]
            tops, where = [], []
            for width, f in zip(WIDTHS, net.filters, strict=True):
                places = WINDOW - width + 1
                total = f[0].take(part[:, :places], axis=0)
                for j in range(1, width):
                    total += f[j].take(part[:, j : j + places], axis=0)
                at = total.argmax(axis=1)
                where.append(at)
                tops.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(tops, axis=1) + net.bias
            hidden = np.maximum(raw, 0)
            score = hidden @ net.dense + net.offset
            score = np.exp(score - score.max(axis=1, keepdims=True))
            prob = score / score.sum(axis=1, keepdims=True)
            prob[np.arange(len(pick)), want] -= 1
            prob *= weight[want][:, None] / len(pick)
            back = (prob @ net.dense.T) * (raw > 0)
            grads = []
            rows = np.arange(len(pick))[:, None]
            columns = np.arange(FILTERS)[None, :]
            for k, (width, at) in enumerate(zip(WIDTHS, where, strict=True)):
                mine = back[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros((width, 256, FILTERS))
                for j in range(width):
                    np.add.at(g[j], (part[rows, at + j], np.broadcast_to(columns, at.shape)), mine)
                    g[j][0] = 0
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ prob, prob.sum(axis=0)]
            turn += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return net


def held_out(doc_id: Column, parts: int = 4, out: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == out, F.lit(False))


def fit(docs: DataFrame, bound: int = TRAIN_DOCS) -> ByteNetwork:
    """A network from about ``bound`` labelled documents at most outside the held-out fold, the same ones at every run;
    copies of a row count once."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, bound / max(1, rows.count()))
    chosen = rows.where(sampled(share, F.lit("lang"), "doc_id", "text")).select(F.col("doc_id").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    lent = chosen.mapInArrow(_lent, "doc_id string, lang string, lent binary").distinct()
    sample = sorted((r["doc_id"], r["lang"], bytes(r["lent"])) for r in lent.collect())
    return train([t for _, _, t in sample], [k for _, k, _ in sample])


def _lent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lent = [stretches(t) if has_letter(t) else None for t in batch.column(2).to_pylist()]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lent, pa.binary())], names=["doc_id", "lang", "lent"])
        yield out.filter(out.column(2).is_valid())


def tagged(docs: DataFrame, network: ByteNetwork, keep: list[str], names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and lang_score, or as ``names`` call them; a kept column that bears
    one of these names gives way to the result."""
    known = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of weights

    def compute(texts: list[str | None]) -> list[list]:
        got = known.value.predict(texts)
        return [[g[0] for g in got], [g[1] for g in got]]

    return mapped(docs, keep, "text", f"`{names[0]}` string, `{names[1]}` double", compute, "language")


def determined(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs whose language the network, fitted on them, can tell: not ``und`` and with a score of ``least`` at least.
    All columns stay as they are, whatever their names."""
    lang, score = (named_apart(docs.columns, n) for n in ("lang_pred", "lang_score"))
    found = tagged(docs, fit(docs), [*docs.columns], (lang, score))
    return found.where((quoted(lang) != UNDETERMINED) & (quoted(score) >= least)).select(*map(quoted, docs.columns))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = tagged(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
