"""Spelling variants: words one edit apart, found through a reduced alphabet, and grouped below their most frequent form.

Letters are hashed to a few symbols, so a word becomes a short-alphabet word of the same length. Two words that differ by one
inserted, deleted or replaced letter have reduced words that differ by one such edit or not at all. So each word generates the
whole one-edit neighbourhood of its reduced word, itself included, as 64-bit keys; these are joined with the keys of the reduced
vocabulary, and what meets is verified on the original strings. A key is a polynomial of the symbols, so that each neighbour's
is made from sums up to a position, whatever the length of the word; keys that agree by chance fall in the verification.

Before the join, neighbours that no word has are left out by a bit map of the reduced vocabulary, of at most 8 MB. In a larger
vocabulary more of them pass, and the result is the same. The number of symbols grows with the vocabulary (8 up to two million
words), so that few words share a reduced one. Where more than ``crowded`` words do, those are met by another exact way: by their
strings with one letter left out, which at most (length + 1) x alphabet words share.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty text in the hash that deletes letters;
repeated rows count again; very long texts and runs are taken whole; of near words that tie in frequency the first in code-point
order is the form; an empty table gives an empty result. Other columns of the documents do not matter."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LETTERS = "A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTERS}]+")
#: Bits of the largest map of reduced words.
MAP_BITS = 1 << 26
#: The base of the polynomials (odd), its inverse modulo 2^64, and a factor that mixes keys for the map.
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_BASE = np.uint64(_BASE)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_counts(docs: DataFrame, thinned: int | None = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word and n of the letter runs of whole texts, A-Z in lower case, of min_length code points and min_count occurrences.

    thinned: a run whose hash with the doc_id this number divides loses one letter, as a stand-in for misspelling; None for
    none. Each task adds up its words before they are shuffled."""
    crc = zlib.crc32

    def run(batches):
        seen: Counter = Counter()

        def flush():
            names = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(map(seen.__getitem__, names), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            pile: list[str] = []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py()
                if not text:
                    continue
                runs = [w for w in _RUN.findall(text.encode().lower().decode()) if len(w) >= min_length]  # bytes.lower: ASCII only
                pile += runs
                if thinned:
                    head, counts = crc(f"{i.as_py() or ''}:".encode()), Counter(runs)
                    for w in [w for w in counts if crc(w.encode(), head) % thinned == 0]:
                        k = counts[w]
                        at = crc(w.encode(), head) % len(w)
                        seen[w] -= k
                        if len(w) > min_length:
                            seen[w[:at] + w[at + 1 :]] += k
                if len(pile) > 100_000:
                    seen.update(pile)
                    pile = []
                if len(seen) > 200_000:
                    yield flush()
            seen.update(pile)
        if seen:
            yield flush()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def _symbols(points: np.ndarray, symbols: int | None) -> np.ndarray:
    """A symbol from 1 on for each letter; None for the letters themselves."""
    p = points.astype(np.uint64)
    return p + np.uint64(1) if symbols is None else ((p * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)


def _keys(words: list[str], symbols: int | None, edits: str) -> tuple[np.ndarray, np.ndarray]:
    """Which word (by index) and key: of the reduced words themselves, and for 'd', 'r' and 'i' in edits of all of theirs with one
    symbol deleted, replaced or inserted. No key twice for a word."""
    order: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        order.setdefault(len(w), []).append(i)
    at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for length, members in order.items():
        step = max(1, 2_000_000 // (length * (2 * (symbols or 1) + 2)))
        for k in range(0, len(members), step):
            some = members[k : k + step]
            s = _symbols(_points([words[i] for i in some], length), symbols)
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(length + 1, _BASE)]), dtype=np.uint64)
            before = np.concatenate([np.zeros((len(some), 1), np.uint64), np.cumsum(s * powers[:length], axis=1, dtype=np.uint64)], 1)
            after = before[:, -1:] - before
            out = [before[:, -1:]]
            if "d" in edits:
                out.append(before[:, :-1] + after[:, 1:] * _BACK)
            for c in map(np.uint64, range(1, (symbols or 0) + 1)):
                if "r" in edits:
                    out.append(before[:, :-1] + after[:, 1:] + c * powers[:length])
                if "i" in edits:
                    out.append(before + after * _BASE + c * powers[: length + 1])
            x = np.sort(np.concatenate(out, 1), 1)
            new = np.concatenate([np.ones((len(some), 1), bool), x[:, 1:] != x[:, :-1]], 1)
            at.append(np.repeat(np.array(some), new.sum(1)))
            keys.append(x[new])
    return np.concatenate(at), np.concatenate(keys)


def _with_keys(words: DataFrame, symbols: int | None, edits: str, held=None) -> DataFrame:
    """The rows of words (word, ...) with key, once for each key; held: a broadcast bit map of the keys that matter."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for k in range(0, len(names), 2000):
                at, keys = _keys(names[k : k + 2000], symbols, edits)
                if held is not None:
                    keep = _held(held.value, keys)
                    at, keys = at[keep], keys[keep]
                part = b.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns), pa.array(keys.view(np.int64))], [*part.schema.names, "key"])

    kinds = ", ".join(f"{c} {t}" for c, t in words.dtypes)
    return words.mapInArrow(run, f"{kinds}, key long")


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - (bits.bit_length() - 1))


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = _slots(keys, len(bitmap) * 64)
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) > 0


def _bit_map(reduced: DataFrame, words: int):
    """A broadcast bit map of the keys of the reduced vocabulary, some 64 bits a word and MAP_BITS at most."""
    bits = min(MAP_BITS, 1 << max(10, (64 * words).bit_length()))
    shift = bits.bit_length() - 1

    def run(batches):
        for b in batches:
            slots = np.unique(_slots(b.column(0).to_numpy().view(np.uint64), bits))
            places = slots >> np.uint64(6)
            starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, np.int64)
            marks = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), starts) if len(starts) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(places[starts].astype(np.int32)), pa.array(marks.view(np.int64))], ["place", "mark"])

    marks = reduced.select("key").mapInArrow(run, "place int, mark long").groupBy("place").agg(F.bit_or("mark").alias("mark"))
    out = np.zeros(1 << (shift - 6), np.uint64)
    found = marks.toArrow()  # 12 bytes for each of at most 2^20 places
    out[found.column("place").to_numpy()] = found.column("mark").to_numpy().view(np.uint64)
    return reduced.sparkSession.sparkContext.broadcast(out)


def symbols_for(words: int) -> int:
    """The least power of two, from 8 on, with as many words of seven symbols as there are words."""
    k = 8
    while k**7 < words:
        k *= 2
    return k


def near_words(vocabulary: DataFrame, symbols: int | None = None, crowded: int = 1000) -> DataFrame:
    """word, near, near_n: each pair of words of vocabulary (word, n; a written table of distinct words) that differ by exactly
    one edit, both ways round."""
    size = vocabulary.count()
    symbols = symbols or symbols_for(size)
    reduced = _with_keys(vocabulary.select("word", "n"), symbols, "").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    held = _bit_map(reduced, size)
    asking = _with_keys(vocabulary.select("word"), symbols, "dri", held)
    full = materialise(reduced.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > crowded).select("key"), "crowded-words")
    one_edit = F.levenshtein("word", "near", 1) == 1
    if full.isEmpty():
        return asking.join(reduced.hint("merge"), "key").where(one_edit).select("word", "near", "near_n")
    plain = asking.join(full.hint("merge"), "key", "left_anti").join(reduced.hint("merge"), "key").where(one_edit).select("word", "near", "near_n")
    askers = asking.join(full.hint("merge"), "key", "left_semi").select("word").distinct()
    members = reduced.join(full.hint("merge"), "key", "left_semi").select("near", "near_n")
    left, right = _with_keys(askers, None, "d"), _with_keys(members, None, "d")
    return plain.union(left.join(right.hint("merge"), "key").where(one_edit).select("word", "near", "near_n").distinct())


def group_variants(vocabulary: DataFrame, ratio: int = 10, symbols: int | None = None, crowded: int = 1000) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of vocabulary (word, n; a written table of distinct words).

    form: the near word of largest n, if that is ratio times the word's or more; root: where forms lead to. As n grows by the
    ratio from form to form, a chain has few links, and roots are found by doubling."""
    pairs = near_words(vocabulary, symbols, crowded)
    best = F.min_by("near", F.struct(-F.col("near_n"), "near"))
    by_word = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.max("near_n").alias("best_n"))
    leads = F.col("best_n") >= ratio * F.col("n")
    x = vocabulary.join(by_word.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n"))
    x = materialise(x, "variant-forms")
    roots = materialise(x.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = materialise(roots.select("word", "root").join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if roots.where("moved").isEmpty():
            break
    return x.join(roots.select("word", "root").hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, **settings) -> DataFrame:
    """Variant groups of the words of documents (doc_id, text); settings go to group_variants."""
    return group_variants(materialise(word_counts(docs), "variant-words"), **settings)


#: DuckDB form: the checksum by a table made from its polynomial, near words by the strings with one letter left out.
SQL = r"""
WITH tb AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
r0 AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
r1 AS (SELECT doc_id, w, count(*) AS k FROM r0 WHERE length(w) >= 7 GROUP BY ALL),
r2 AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))::UBIGINT[] AS bs FROM r1),
r3 AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM r2, tb),
r4 AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM r3),
v AS (SELECT word, sum(k)::BIGINT AS n FROM r4 WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
s AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS less FROM d),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT s.word, v.word, v.n FROM s JOIN v ON s.less = v.word UNION SELECT v.word, s.word, s.n FROM s JOIN v ON s.less = v.word),
b AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -struct_extract(best, 1) >= 10 * n THEN struct_extract(best, 2) END AS form, CASE WHEN -struct_extract(best, 1) >= 10 * n THEN -struct_extract(best, 1) END AS form_n FROM v LEFT JOIN b USING (word)),
c1 AS (SELECT f.word, coalesce(g.form, f.form, f.word) AS root FROM f LEFT JOIN f g ON f.form = g.word),
c2 AS (SELECT a.word, coalesce(b.root, a.root) AS root FROM c1 a LEFT JOIN c1 b ON a.root = b.word),
c3 AS (SELECT a.word, coalesce(b.root, a.root) AS root FROM c2 a LEFT JOIN c2 b ON a.root = b.word),
c4 AS (SELECT a.word, coalesce(b.root, a.root) AS root FROM c3 a LEFT JOIN c3 b ON a.root = b.word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN c4 USING (word)
"""
