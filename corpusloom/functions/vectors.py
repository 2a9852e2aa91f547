"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _buckets(digest, items: list[bytes], size: int) -> np.ndarray:
    """The digests of items as numbers, modulo size, taken 32 bits at a time. Copies of one empty hash cost less than new ones."""
    empty, digests = digest(), []
    for x in items:
        h = empty.copy()
        h.update(x)
        digests.append(h.digest())
    left = np.zeros(len(items), np.int64)
    for part in np.frombuffer(b"".join(digests), ">u4").reshape(len(items), empty.digest_size // 4).T:
        left = ((left << 32) + part) % size
    return left


def hashed_sums(texts: list[list[bytes]], size: int = 384) -> np.ndarray:
    """A row for each text, given as its words: hashes of words (weight 1.5) and word pairs (weight 2), signed by bucket parity."""
    pairs = [[a + b"_" + b for a, b in zip(words, words[1:], strict=False)] for words in texts]
    out = np.zeros(len(texts) * size)
    for digest, items, weight in ((hashlib.md5, texts, 1.5), (hashlib.sha256, pairs, 2.0)):
        row = np.repeat(np.arange(len(texts)), [len(x) for x in items])
        out += weight * np.bincount(row * size + _buckets(digest, [x for some in items for x in some], size), minlength=len(out))
    out = out.reshape(len(texts), size)
    out[:, 1::2] *= -1
    return out


def hashed_vector(text: str | None, size: int = 384) -> list[float]:
    """Unit vector of a text from hashes of its words and word pairs."""
    v = hashed_sums([" ".join(text.lower().split()).encode().split(b" ") if text and not text.isspace() else []], size)[0]
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    """Hashed vectors of a column; a 128-bit modulus has no built-in form. Another embedder can take its place."""
    return texts.map(hashed_vector)
