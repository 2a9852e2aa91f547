"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one binned feature at a time are boosted in turn, round after round, with a small rate, and add up to
one lookup table per feature; then trees on two features are boosted on the most promising pairs and add up to small
grids. A document's score is the logistic of the sum of its table entries, looked up for whole batches.

Labels come from a bounded sample of rows that are not held out (crc32 of the id, see ``HELD_OUT``). Defined cases: null,
empty and blank texts have all counts 0 and get the score of those; very long texts are counted whole; texts with equal
counts score alike, a feature at a bin's edge belongs to the lower bin, and a score at the threshold is predicted 1; a null
doc_id counts as the empty text for the
split; repeated rows score alike; without labels of both classes every score is the share of label 1 (0.5 without
labels); empty tables give empty results. Only doc_id and text are read."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, labelled_sample
from .quality_rules import FEATURES, features
from .textstats import COLUMNS, text_statistics

MAX_TRAIN = 8000
HELD_OUT = 5
THRESHOLD = 0.3
_BINS, _GRID, _PAIRS = 48, 8, 6


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(c, x[:, f])]
        for f, g, cf, cg, grid in self.pairs:
            out += grid[np.searchsorted(cf, x[:, f]), np.searchsorted(cg, x[:, g])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _quantiles(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _best(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _tree1(g: np.ndarray, h: np.ndarray, l2: float, leaves: int = 4) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over the bins of one feature, as its table."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, (lo, hi) = max(((*_best(g[a:b], h[a:b], l2), (a, b)) for a, b in parts), key=lambda p: p[0])
        if gain <= 1e-9:
            break
        parts.remove((lo, hi))
        parts += [(lo, lo + at), (lo + at, hi)]
    table = np.zeros(len(g))
    for a, b in parts:
        table[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return table


def _tree2(g: np.ndarray, h: np.ndarray, l2: float, depth: int = 2) -> tuple[np.ndarray, float]:
    """A tree of the given depth over a grid of two features, as its grid, and its gain at the root."""
    (ga, ia), (gb, ib) = _best(g.sum(1), h.sum(1), l2), _best(g.sum(0), h.sum(0), l2)
    gain = max(ga, gb)
    if depth == 0 or gain <= 1e-9:
        return np.full(g.shape, -g.sum() / (h.sum() + l2)), 0.0
    if ga >= gb:
        (x, p), (y, q) = _tree2(g[:ia], h[:ia], l2, depth - 1), _tree2(g[ia:], h[ia:], l2, depth - 1)
        return np.vstack((x, y)), gain + p + q
    (x, p), (y, q) = _tree2(g[:, :ib], h[:, :ib], l2, depth - 1), _tree2(g[:, ib:], h[:, ib:], l2, depth - 1)
    return np.hstack((x, y)), gain + p + q


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, l2: float = 2.0) -> Gam:
    if len(y) == 0:
        return Gam(0.0)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    model.cuts = [_quantiles(v, _BINS) for v in x.T]
    binned = [np.searchsorted(c, v) for c, v in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(len(y), model.base)

    def slope():
        prob = 1 / (1 + np.exp(-margin))
        return prob - y, prob * (1 - prob)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            g, h = slope()
            step = rate * _tree1(np.bincount(b, g, len(model.tables[f])), np.bincount(b, h, len(model.tables[f])), l2)
            model.tables[f] += step
            margin += step[b]
    coarse = [_quantiles(v, _GRID) for v in x.T]
    low = [np.searchsorted(c, v) for c, v in zip(coarse, x.T, strict=True)]

    def grid(i, j, v):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(low[i] * shape[1] + low[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    every = [(i, j) for i in range(len(low)) for j in range(i + 1, len(low))]
    best = sorted(every, key=lambda ij: -_tree2(grid(*ij, g), grid(*ij, h), l2)[1])[:_PAIRS]
    grids = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in best}
    for _ in range(pair_rounds):
        for i, j in best:
            g, h = slope()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h), l2)[0]
            grids[i, j] += step
            margin += step[low[i], low[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in grids.items()]
    return model


def _features(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column(batch.schema.get_field_index("text"))
    return features(np.array([text_statistics(t.as_py()) for t in texts], np.int64).reshape(-1, len(COLUMNS)))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Gam:
    """The model of at most ``max_train`` labelled documents that are not held out."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("label")).cast(pa.int32()), *(pa.array(c) for c in _features(b).T)], ["label", *FEATURES])

    rows = labelled_sample(docs, labels, "quality", max_train, lambda c: crc32_mod(c, HELD_OUT) != 0)
    rows = rows.select("label", "text").mapInArrow(run, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    return fit_gam(rows[list(FEATURES)].to_numpy(), (rows["label"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            score = model.score(_features(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (crc32_mod(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
