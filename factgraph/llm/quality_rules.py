"""Operator 6: a sparse rule ensemble for document quality (after Friedman and Popescu 2008).

``statistics`` describes every whole text by the numbers in ``STATISTICS``. Small trees are boosted on at most
TRAIN_DOCS labelled documents outside the held-out fold; every path from a root to a node of a tree is a rule, a
conjunction of bounds on statistics. A logistic model with a lasso penalty weighs the rules and sets most weights to
zero, and those left are compiled into one Spark column, so scoring stays within whole-stage code.

Rows: null text counts as empty, an empty text has all statistics 0 and gets a score like any other; labels of
documents that do not exist, null labels and null doc_ids are left out; a label repeated for a doc_id counts once, two
different ones count both; repeated rows of documents are learnt from as often as they come, and every row gets a score
of its own. Equal texts get equal scores. Where all n labels are of one kind, or n is below LEAST_LABELS, no rule could
be told from chance, and every score is (k + 1) / (n + 2) for k labels of 1: the share of label 1, drawn towards 0.5, and
0.5 without any label. An empty table gives an empty result.
Neither lang nor source nor doc_id is read by the model. Kept columns that bear a result's name give way to it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import kept_beside, mapped, quoted, sampled, table
from factgraph.llm.language import held_out

TRAIN_DOCS = 12_000
#: Labelled rows that a rule needs to be looked for.
LEAST_LABELS = 40
STATISTICS = (
    "n_bytes",
    "n_words",
    "n_lines",
    "mean_word",
    "longest_word",
    "upper",
    "digits",
    "symbols",
    "exclaims",
    "pipes",
    "commas",
    "stops",
    "wide",
    "blanks",
    "distinct_words",
    "top_word",
    "adjacent_repeats",
    "distinct_lines",
    "mean_line",
    "short_words",
    "marked_words",
    "distinct_pairs",
)
_SYMBOLS = np.array([c in b"#$%&*+<=>@\\^_`{}~[]/" for c in range(256)])


def describe(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words = len(raw), raw.split()
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = Counter(words)
    lengths = list(map(len, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(size),
        float(len(words)),
        float(len(lines)),
        sum(lengths) / n,
        float(max(lengths, default=0)),
        float(count[65:91].sum()) / letters,
        float(count[48:58].sum()) / size,
        float(count[_SYMBOLS].sum()) / size,
        float(count[33]) / n,
        float(count[124]) / n,
        float(count[44]) / n,
        float(count[46]) / n,
        float(count[128:].sum()) / size,
        float(count[32]) / size,
        len(kinds) / n,
        max(kinds.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        size / max(1, len(lines)),
        sum(k <= 2 for k in lengths) / n,
        sum(1 for w in words if w[-1:] in b"!#$%&*") / n,
        (pairs + 1) / n,
    ]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs(text) and the statistics, each a double; a kept column called like a statistic gives way."""

    def compute(texts: list[str | None]) -> list[list]:
        return list(np.array([describe(t) for t in texts], np.float64).reshape(-1, len(STATISTICS)).T)

    return mapped(docs, keep, "text", ", ".join(f"stat_{s} double" for s in STATISTICS), compute, "quality_rules", 512)


#: A rule: (statistic, whether its value must be above, bound) for each condition.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    offset: float

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        total = F.lit(self.offset)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(f"stat_{STATISTICS[k]}") > F.lit(bound) if above else F.col(f"stat_{STATISTICS[k]}") <= F.lit(bound) for k, above, bound in rule]
            total = total + F.when(reduce(and_, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + rule_matrix(self.rules, values) @ np.array(self.weights))))


def rule_matrix(rules: list[Rule], values: np.ndarray) -> np.ndarray:
    out = np.ones((len(values), len(rules)), np.float64)
    for r, rule in enumerate(rules):
        for k, above, bound in rule:
            out[:, r] *= values[:, k] > bound if above else values[:, k] <= bound
    return out


def tree_rules(values: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 48, rate: float = 0.2, seed: int = 3) -> list[Rule]:
    """The rules of boosted trees on random halves of rows and statistics; splits lie at quantiles."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(values[:, k], np.linspace(0.005, 0.995, bins))) for k in range(values.shape[1])]
    place = np.stack([np.searchsorted(c, values[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    raw = np.full(len(label), np.log(label.mean() / (1 - label.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        gradient, curvature = label - prob, prob * (1 - prob)
        usable = rng.choice(values.shape[1], max(1, values.shape[1] // 2), replace=False)
        rows = rng.random(len(label)) < 0.5
        nodes: list[tuple[np.ndarray, Rule, int]] = [(np.arange(len(label)), (), 0)]
        while nodes:
            at, rule, level = nodes.pop()
            seen = at[rows[at]]
            best = (1e-6, None, None)
            if level < depth and len(seen) >= 20:
                g_all, h_all = gradient[seen].sum(), curvature[seen].sum()
                for k in usable:
                    if len(cuts[k]) < 2:
                        continue
                    g = np.cumsum(np.bincount(place[seen, k], gradient[seen], len(cuts[k]) + 1))[:-1]
                    h = np.cumsum(np.bincount(place[seen, k], curvature[seen], len(cuts[k]) + 1))[:-1]
                    n = np.cumsum(np.bincount(place[seen, k], minlength=len(cuts[k]) + 1))[:-1]
                    gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
                    gain[(n < 5) | (len(seen) - n < 5)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
            if best[1] is None:
                raw[at] += rate * gradient[seen].sum() / (curvature[seen].sum() + 1)
                continue
            _, k, cut = best
            low = place[at, k] <= cut
            for side, above in ((at[low], False), (at[~low], True)):
                longer = (*rule, (int(k), above, float(cuts[k][cut])))
                rules[tuple(sorted(longer))] = None
                nodes.append((side, longer, level + 1))
    return list(rules)


def lasso(matrix: np.ndarray, label: np.ndarray, penalty: float = 2e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model with a lasso penalty, by accelerated proximal steps."""
    n, m = matrix.shape
    scale = np.maximum(matrix.std(axis=0), 0.02)
    x = (matrix / scale).astype(np.float32)
    probe = np.ones(m, np.float32)
    for _ in range(20):
        probe = x.T @ (x @ probe)
        top = float(np.linalg.norm(probe))
        probe /= max(top, 1e-12)
    step = 4 * n / max(top + n, 1e-12)
    w, b = np.zeros(m), float(np.log(label.mean() / (1 - label.mean())))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(x @ vw.astype(np.float32) + vb))) - label
        nw = vw - step * (x.T @ miss.astype(np.float32)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * float(miss.mean())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / scale, b


def train(values: np.ndarray, label: np.ndarray) -> RuleEnsemble:
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or len(label) < LEAST_LABELS:
        return RuleEnsemble([], [], float(np.log((share * len(label) + 1) / ((1 - share) * len(label) + 1))))
    rules = tree_rules(values, label)
    weights, offset = lasso(rule_matrix(rules, values), label)
    live = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble([rules[k] for k in live], [float(weights[k]) for k in live], float(offset))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> RuleEnsemble:
    """An ensemble from about ``bound`` labelled documents outside the held-out fold at most, chosen by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label")).distinct()
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.where(sampled(share, F.lit("quality"), "__id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # about ``bound`` rows of ids at most
    got = statistics(rows, ["doc_id", "__label"]).collect()
    got = sorted((tuple(r) for r in got))
    return train(np.array([r[2:] for r in got], np.float64).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got], np.float64))


def scored(docs: DataFrame, model: RuleEnsemble, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and quality_score, which takes the place of a kept column of its name."""
    keep = kept_beside(keep, ["quality_score"])
    plain = [f"kept_{i}" for i in range(len(keep))]
    apart = docs.select(*(quoted(c).alias(p) for c, p in zip(keep, plain, strict=True)), F.col("text").alias("text"))
    return statistics(apart, plain).select(*plain, model.column()).toDF(*keep, "quality_score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    score = F.col("quality_score")
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))
