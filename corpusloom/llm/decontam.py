"""Benchmark decontamination with an FM-index per training shard.

Documents of a partition are gathered into shards of about ``SHARD_WORDS`` words; a longer document is a shard of its
own. Over each shard an FM-index is built once (see ``fm_index``), all windows of the test phrases are searched backward
through its wavelet ranks, occurrences are located by sampled suffix positions, and the hit words merge into spans.
No shuffle takes place. Texts become word numbers as they are read, so a shard holds four bytes a word.

Test phrases reach the tasks as arrays of word numbers, in passes of at most ``PASS_BYTES`` of their text; a benchmark
beyond that takes another pass over the documents, and what the passes find is merged. In each shard, windows with a
word that the shard lacks are left out by one look at the array, before any search.

Words: A-Z lower-cased, runs of anything but ASCII non-alphanumerics. A window is 10 consecutive words of an item; an
item of fewer words is one window. Defined cases: null texts and texts without words have no words; items without
words have no window, items with a null id are called by the empty text, items that repeat each count by their id; very
long texts are searched whole; repeated rows are judged alike; empty tables give no hits or no rows. Only doc_id and
text (item_id and text) are read; columns of docs named as an output are replaced, and ``decontaminate`` gives all
columns of docs back as they were."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 250_000
#: Bytes of test phrases that one pass sends to the tasks.
PASS_BYTES = 8_000_000
#: Windows that are searched at a time.
_AT_ONCE = 65_536
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_ADDED = ("items", "spans", "n_words")
_STATE = "items array<string>, spans array<struct<start:bigint,end:bigint>>, n_words long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Phrases:
    """Items of a pass: distinct words, the word numbers of all items one after another, and the windows as the place
    after their last word and their length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        flat, ends, names = array("i"), [], []
        for name, text in items:
            w = words(text)
            if w:
                flat.extend(map(numbers.__getitem__, w))
                ends.append(len(flat))
                names.append(name)
        self.vocabulary, self.names = b" ".join(numbers), names
        self.flat = np.array(flat, np.int32)
        last = np.array(ends, np.int64)
        size = np.diff(last, prepend=0)
        per = np.maximum(1, size - window + 1)
        self.item = np.repeat(np.arange(len(names), dtype=np.int32), per)
        within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.length = np.repeat(np.minimum(size, window), per).astype(np.int32)
        self.end = (np.repeat(last - size, per) + within + self.length).astype(np.int64)


class Shard:
    """Documents as word numbers, until they are searched."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        w = words(text)
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, w), np.int32, len(w)))
        self.size += len(w)


def search_shard(shard: Shard, phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged hit spans (word numbers, end exclusive) and items of each document of a shard."""
    docs, n = shard.docs, len(shard.docs)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if not len(phrases.end) or not shard.size:
        return spans, items
    known = np.fromiter((shard.numbers.get(w, -1) for w in phrases.vocabulary.split(b" ")), np.int32)
    flat = known[phrases.flat]
    missing = np.concatenate(([0], np.cumsum(flat < 0)))
    live = np.flatnonzero(missing[phrases.end] == missing[phrases.end - phrases.length])
    if not len(live):
        return spans, items
    starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
    text = np.empty(starts[-1], np.int32)
    for k, d in enumerate(docs):  # 0 to n - 1 end the documents
        text[starts[k] : starts[k + 1] - 1] = d
        text[starts[k] : starts[k + 1] - 1] += n
        text[starts[k + 1] - 1] = k
    flat += n
    index = FMIndex(text)
    rows = []
    for at in range(0, len(live), _AT_ONCE):
        w = live[at : at + _AT_ONCE]
        lo, hi = index.search(flat, phrases.end[w], phrases.length[w])
        hit = hi > lo
        rows.append(np.column_stack((lo[hit], hi[hit], phrases.length[w[hit]], phrases.item[w[hit]])))
    found = np.concatenate(rows)
    if not len(found):
        return spans, items
    same, group = np.unique(found[:, :3], axis=0, return_inverse=True)  # equal windows have equal rows
    of_group: list[set[int]] = [set() for _ in same]
    for g, item in zip(group.ravel().tolist(), found[:, 3].tolist(), strict=True):
        of_group[g].add(item)
    edge = np.zeros(len(text) + 1, np.int32)
    pairs = []
    for g, (lo, hi, length) in enumerate(same.tolist()):
        at = index.locate(np.arange(lo, hi)) if hi - lo > 1000 else None
        if at is not None:
            pairs.append(_mark(edge, at, length, np.full(len(at), g), starts))
    few = np.flatnonzero(same[:, 1] - same[:, 0] <= 1000)
    for k in range(0, len(few), 1000):
        part = same[few[k : k + 1000]]
        times = part[:, 1] - part[:, 0]
        at = index.locate(np.repeat(part[:, 0] - (np.cumsum(times) - times), times) + np.arange(times.sum()))
        pairs.append(_mark(edge, at, np.repeat(part[:, 2], times), np.repeat(few[k : k + 1000], times), starts))
    hit = np.concatenate(([False], np.cumsum(edge[:-1]) > 0))
    change = np.flatnonzero(hit[1:] != hit[:-1])
    for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):  # a document's end is never hit
        k = int(np.searchsorted(starts, s, side="right")) - 1
        spans[k].append((s - int(starts[k]), e - int(starts[k])))
    for part in pairs:
        for k, g in part.tolist():
            items[k].update(phrases.names[i] for i in of_group[g])
    return spans, items


def _mark(edge: np.ndarray, at: np.ndarray, length, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts occurrences into edge; returns the distinct pairs of document and group."""
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.unique(np.column_stack((np.searchsorted(starts, at, side="right") - 1, group)), axis=0)


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _pass(docs: DataFrame, phrases: Phrases, shard_words: int, cut: list[str] | None = None) -> DataFrame:
    """docs with the columns items, spans and n_words, joined with what earlier passes found. cut: the columns to return
    instead, with the spans cut out of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)  # of at most PASS_BYTES of text
    out = cut or [*(c for c in docs.columns if c not in _ADDED)]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)

    def run(batches):
        held, shard = [], Shard()

        def flush():
            spans, items = search_shard(shard, sent.value)
            at = 0
            for b in held:
                span = slice(at, at + b.num_rows)
                mine, names, counts = spans[span], items[span], [len(d) for d in shard.docs[span]]
                at += b.num_rows
                if "spans" in b.schema.names:
                    mine = [_merge(m, [(x["start"], x["end"]) for x in old]) for m, old in zip(mine, b.column("spans").to_pylist(), strict=True)]
                    names = [n | set(old) for n, old in zip(names, b.column("items").to_pylist(), strict=True)]
                cols = {c: b.column(c) for c in out}
                if cut is None:
                    state = (pa.array([sorted(n) for n in names], pa.list_(pa.string())), pa.array([[{"start": s, "end": e} for s, e in m] for m in mine], _SPANS), pa.array(counts, pa.int64()))
                    cols |= dict(zip(_ADDED, state, strict=True))
                elif any(mine):
                    cols["text"] = pa.array([remove_spans(t.as_py(), m) if m else t.as_py() for t, m in zip(b.column("text"), mine, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        for b in batches:
            column = b.column("text")
            at = 0
            for i in range(b.num_rows):
                shard.add(column[i].as_py())
                if shard.size >= shard_words:
                    held.append(b.slice(at, i + 1 - at))
                    yield from flush()
                    held, shard, at = [], Shard(), i + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        yield from flush()

    return docs.mapInArrow(run, kinds if cut else f"{kinds}, {_STATE}")


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, cut: list[str] | None = None) -> DataFrame:
    """docs (any columns, with text; columns named as an output are replaced) plus items, the ids of items found, spans, the
    merged hit spans in words, and n_words. With ``cut``, the columns named there alone, and the text without the spans."""
    docs = docs.drop(*_ADDED)
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    passes = max(1, -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    for k in range(passes):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        docs = _pass(docs, Phrases([(r[0], r[1]) for r in part.toLocalIterator()], window), shard_words, cut if k == passes - 1 else None)
    return docs


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans of each row of docs."""
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_distinct("items").alias("items"), "spans")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for s, e in spans:
        out.append(text[end : at[s][0]])
        end = at[e - 1][1]
    return "".join(out) + text[end:]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of docs, with test passages cut out of the text."""
    names = [f"c_{i}" if c != "text" else "text" for i, c in enumerate(docs.columns)]
    renamed = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(names, docs.columns, strict=True)))
    return find_passages(renamed, benchmark, cut=names).select(*(F.col(k).alias(c) for k, c in zip(names, docs.columns, strict=True)))


#: DuckDB form: each window of each item against the same-length windows of the documents.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k.n, i, array_to_string(w[i:i + k.n - 1], ' ') AS g
       FROM (SELECT doc_id, w, k.n, unnest(range(1, len(w) - k.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) k WHERE len(w) >= k.n) k),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
