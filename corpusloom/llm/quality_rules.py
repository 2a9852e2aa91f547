"""Quality rules: fixed floor rules plus gradient-boosted trees over document statistics.

The trees are fitted on a bounded labelled sample, with monotonic constraints on the features that measure
junk (more of it never raises the score), then flattened into numpy node arrays of complete binary trees,
so that a batch of documents is scored by ``depth`` gathers for all trees at once.

Defined cases: a null, empty or blank text has no words and fails the floor; very long texts are counted whole; a null
doc_id is kept as null; repeated rows are judged one by one and alike, and a score at the bound is kept; empty tables give empty results; without labels of both
classes there is no model and the floor rules alone decide. Only doc_id and text are read, so further
columns of any name do not matter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample
from .textstats import COLUMNS, text_statistics

#: Bound of the labelled rows that a model is fitted on.
MAX_TRAIN = 8000
#: A document that passes the floor is rejected below this probability of good quality.
MIN_SCORE = 0.3

FEATURES = ("log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "punct_per_word", "digit_share", "capital_word_share")
#: -1: the score may not rise with the feature.
MONOTONE = (0, 0, -1, -1, -1, -1, -1, -1, -1)


def features(stats: np.ndarray) -> np.ndarray:
    """Rows of COLUMNS to rows of FEATURES; shares of nothing are 0."""
    s = stats.astype(np.float64).reshape(-1, len(COLUMNS))
    n_words, chars, symbols, dup, repeat, lines, _, upper, lower, punct, digits, capital = s.T
    words = np.maximum(n_words, 1)
    return np.column_stack((np.log1p(n_words), chars / words, symbols / np.maximum(chars, 1), dup / np.maximum(lines, 1), repeat / words, upper / np.maximum(upper + lower, 1), punct / words, digits / np.maximum(chars, 1), capital / words))


@dataclass
class Trees:
    """Complete binary trees of one depth as node arrays: inner nodes (trees, 2**depth - 1), leaves (trees, 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, (trees, inner) = len(x), self.feature.shape
        out = np.full(n, self.base)
        rows = np.arange(n)[:, None]
        for at in range(0, n, 4096):  # bounds the gathers
            r = rows[at : at + 4096]
            node = np.zeros((len(r), trees), np.int64)
            t = np.arange(trees)[None, :]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[r, self.feature[t, node]] > self.threshold[t, node])
            out[at : at + 4096] += self.leaf[t, node - inner].sum(1)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone=MONOTONE, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 5.0) -> Trees | None:
    """Histogram boosting of the logistic loss. A split on a constrained feature is taken only if its leaf values
    are ordered, and its children inherit the midpoint as a bound, so that whole trees are monotonic."""
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    feature, threshold, leaves = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    margin = np.full(len(y), base)

    def value(g, h, lo, hi):
        return np.clip(-g / (h + l2), lo, hi)

    for k in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for j in range(inner):
            lo, hi = bounds[j]
            mine = np.flatnonzero(node == j)
            best = (1e-6, None)
            if len(mine) > 20:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, f], g[mine], len(c) + 1))
                    hs = np.cumsum(np.bincount(binned[mine, f], h[mine], len(c) + 1))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    vl, vr = value(gl, hl, lo, hi), value(gr, hr, lo, hi)
                    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
                    v0 = value(gs[-1], hs[-1], lo, hi)
                    gain += gs[-1] * v0 + 0.5 * (hs[-1] + l2) * v0**2
                    gain[(hl < 0.5) | (hr < 0.5)] = -np.inf
                    if monotone[f]:
                        gain[(vr - vl) * monotone[f] < 0] = -np.inf
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (gain[i], (f, i, vl[i], vr[i]))
            kids = {2 * j + 1: (lo, hi), 2 * j + 2: (lo, hi)}
            if best[1]:
                f, i, vl, vr = best[1]
                feature[k, j], threshold[k, j] = f, cuts[f][i]
                if monotone[f]:
                    mid = (vl + vr) / 2
                    kids = {2 * j + 1: (mid, hi), 2 * j + 2: (lo, mid)} if monotone[f] < 0 else {2 * j + 1: (lo, mid), 2 * j + 2: (mid, hi)}
            node[mine] = 2 * j + 1 + (x[mine, feature[k, j]] > threshold[k, j])
            bounds |= kids
        for j in range(inner, 2 * inner + 1):
            mine = node == j
            leaves[k, j - inner] = rate * value(g[mine].sum(), h[mine].sum(), *bounds[j])
        margin += leaves[k, node - inner]
    return Trees(base, feature, threshold, leaves)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column(batch.schema.get_field_index("text"))
    return np.array([text_statistics(t.as_py()) for t in texts], np.int64).reshape(-1, len(COLUMNS))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees | None:
    """Trees fitted on at most ``max_train`` labelled documents; their statistics alone reach the driver."""
    schema = "label int, " + ", ".join(f"{c} long" for c in COLUMNS)

    def run(batches):
        for b in batches:
            s = _stats(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("label")).cast(pa.int32()), *(pa.array(c) for c in s.T)], ["label", *COLUMNS])

    rows = labelled_sample(docs, labels, "quality", max_train).select("label", "text").mapInArrow(run, schema).toPandas()
    return fit_trees(features(rows[list(COLUMNS)].to_numpy()), (rows["label"].to_numpy() > 0).astype(float))


def verdicts(stats: np.ndarray, model: Trees | None, min_score: float = MIN_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and score of rows of COLUMNS."""
    failed = (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])
    score = model.score(features(stats)) if model is not None and len(stats) else np.ones(len(stats))
    return failed, ~failed & (score >= min_score), score


def judge(docs: DataFrame, model: Trees | None, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and score of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = COLUMNS[:5]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, score double"

    def run(batches):
        for b in batches:
            s = _stats(b)
            failed, kept, score = verdicts(s, model, min_score)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *(pa.array(c) for c in s.T[:5]), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *counts, "base_failed", "kept", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(verdicts(_stats(b), model, min_score)[1]))

    return docs.mapInArrow(run, docs.schema)
