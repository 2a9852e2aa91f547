"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, everything but letters becomes one blank, and the 4- to 6-grams of characters are taken as 64-bit
hashes. Over a bounded sample of labelled rows that are not held out, the documents with each n-gram are counted by class;
n-grams of ``MIN_DOCS`` documents or more whose classes differ by a chi-square of ``MIN_CHI2`` (a chance of 0.001) are features, with the log of
the ratio of their smoothed shares. Presence of an n-gram times its ratio is the feature of a logistic regression.
Scoring looks up all n-grams of the whole text: a table of bits leaves out most, the 64-bit hash decides.

Defined cases: null, empty and letterless texts have no n-gram and score by the intercept alone; very long texts are
folded whole and hashed piece by piece, with the same n-grams; a null doc_id counts as the empty text for the split;
repeated rows, and texts with the same n-grams, score alike, and a score at the threshold is predicted 1; without labels of
both classes every score is the share of label 1 (0 without labels); empty tables give empty results. Only doc_id and text
are read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, labelled_sample, materialise

#: Bound of the labelled rows that a model is fitted on, and so of its n-grams.
MAX_TRAIN = 16000
MIN_DOCS = 5
MIN_CHI2 = 10.8
HELD_OUT, HELD_REST = 3, 1
THRESHOLD = 0.7
#: Of the table of bits.
BITS = 19
_SIZES = (4, 5, 6)
_PIECE = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def folded(text: str) -> np.ndarray:
    """Code points of the lower-case text, with one blank for each run of other characters than letters and at both ends."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32).copy()
    code[(code < 97) | ((code > 122) & (code < 0xAA))] = 32
    blank = code == 32
    return code[~(blank & np.concatenate(([False], blank[:-1])))]


def grams(text: str | None):
    """The hashed n-grams of a text, piece by piece."""
    if not text:
        return
    whole = folded(text)
    for at in range(0, len(whole), _PIECE):
        code = whole[at : at + _PIECE + max(_SIZES) - 1].astype(np.uint64)
        with np.errstate(over="ignore"):
            h = code
            for n in range(2, max(_SIZES) + 1):
                h = (h[:-1] * _BASE) ^ code[n - 1 :]
                if not len(h):
                    break
                if n in _SIZES:
                    yield (h[:_PIECE] + np.uint64(n)) * _BASE


def distinct_grams(text: str | None) -> np.ndarray:
    found = list(grams(text))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass
class NbLinear:
    """ids: sorted hashes of the n-grams with a weight."""

    intercept: float
    ids: np.ndarray
    weights: np.ndarray

    def __getstate__(self):
        return {"intercept": self.intercept, "ids": self.ids, "weights": self.weights}

    @cached_property
    def maybe(self) -> np.ndarray:
        """Whether an n-gram with these first bits has a weight."""
        t = np.zeros(1 << BITS, bool)
        t[self.ids >> np.uint64(64 - BITS)] = True
        return t

    def present(self, text: str | None) -> np.ndarray:
        """Numbers of the n-grams with a weight that a text has."""
        found = [h[self.maybe[(h >> np.uint64(64 - BITS)).view(np.int64)]] for h in grams(text)] if len(self.ids) else []
        if not found:
            return np.zeros(0, np.int64)
        h = np.concatenate(found)
        at = np.minimum(np.searchsorted(self.ids, h), len(self.ids) - 1)
        has = np.zeros(len(self.ids), bool)
        has[at[self.ids[at] == h]] = True
        return np.flatnonzero(has)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[self.present(text)].sum(), -30, 30))))


def fit_logistic(owner: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, l2: float = 1.0, steps: int = 200, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Intercept and weights (ratio included) by full-batch Adam steps on the mean loss. owner, col: the document and the
    n-gram of each presence."""
    w, b = np.ones(len(ratio)) * 0.1, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        margin = b + np.bincount(owner, (w * ratio)[col], len(y))
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        g = np.bincount(col, err[owner], len(ratio)) * ratio + l2 * w / len(y) / 10
        gb = err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**k, 1 - 0.999**k
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return b, w * ratio


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_chi2: float = MIN_CHI2) -> NbLinear:
    """The classifier of at most ``max_train`` labelled documents that are not held out; the n-grams that tell the classes
    apart and their numbers in those documents reach the driver."""
    rows = labelled_sample(docs, labels, "toxic", max_train, lambda c: crc32_mod(c, HELD_OUT) != HELD_REST)
    sample = materialise(rows.select(F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "text"), "toxic-sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = NbLinear(float(np.log((toxic + 1e-9) / (n - toxic + 1e-9))) if n else -30.0, np.zeros(0, np.uint64), np.zeros(0))
    if toxic in (0, n):
        return none
    sample = sample.repartition(max(1, -(-n // 500)))

    def count(batches):
        held, size = ([], []), 0

        def flush():
            ids = np.unique(np.concatenate(held[0] + held[1]))
            times = []
            for x in held:
                one, k = np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                of = np.zeros(len(ids), np.int64)
                of[np.searchsorted(ids, one)] = k
                times.append(of)
            for at in range(0, len(ids), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s].view(np.int64)), pa.array(times[0][s]), pa.array(times[1][s])], ["gram", "clean", "toxic"])

        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = distinct_grams(text.as_py())
                held[label].append(found)
                size += len(found)
                if size > 2_000_000:
                    yield from flush()
                    held, size = ([], []), 0
        if size:
            yield from flush()

    by_gram = sample.mapInArrow(count, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q, both = F.col("toxic") / toxic, F.col("clean") / (n - toxic), (F.col("toxic") + F.col("clean")) / n
    chi2 = toxic * (n - toxic) / n * (p - q) * (p - q) / (both * (1 - both) + 1e-9)
    kept = by_gram.where((F.col("toxic") + F.col("clean") >= MIN_DOCS) & (chi2 >= min_chi2)).toPandas()
    if not len(kept):
        return none
    ids = kept["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    ratio = (np.log((kept["toxic"].to_numpy() + 1) / (toxic + 2)) - np.log((kept["clean"].to_numpy() + 1) / (n - toxic + 2)))[order]
    model = NbLinear(0.0, ids[order], ratio)

    def present(batches):
        for b in batches:
            found = [model.present(t.as_py()).astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "at"])

    found = sample.mapInArrow(present, "label int, at array<int>").toArrow()
    at = found.column("at").combine_chunks()
    owner = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(at.offsets.to_numpy()))
    intercept, weights = fit_logistic(owner, at.values.to_numpy(), found.column("label").to_numpy().astype(float), ratio)
    return NbLinear(intercept, model.ids, weights)


def classify(docs: DataFrame, model: NbLinear, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            score = np.array([model.score(t.as_py()) for t in b.column(2)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (crc32_mod(F.col("doc_id"), HELD_OUT) == HELD_REST).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
