"""N-gram Jaccard join by MinHash banding.

Texts with the same set of word 5-grams form one text class, so copies are handled once. MinHash signatures are cut
into bands, whose number and height follow from the recall asked for at the threshold, and classes are shuffled on
band hashes. Classes that share a band are placed in blocks of bounded size, by the least class that they meet in two steps over
shared bands, so that the members of a band lie in few blocks; for each two blocks that share a band, one group gets the full n-gram sets of both and counts exact intersections by matrix
products over the n-grams found more than once. Every pair of classes lies in one such group at most, so links are
counted without writing a row for each pair, and large groups of near copies are split over many tasks.

Result: one row per document with the class of its near copies (the least doc_id of the connected component), the
least doc_id of its text class, the number of its exact copies and of links to different text classes.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, case counts; a text of 1 to 4 words is one n-gram; texts without a
word (null, empty, blank) are linked with nothing and stand alone; very long texts take part with all their n-grams; rows
with equal doc_id are separate documents with the same id; of tied names the least doc_id, then the least text hash, is
taken; a null doc_id takes part and names a class only if it has no other id; empty tables give empty results. Only doc_id
and text are read; ``keep_one_each`` gives all columns of docs back, whatever their names."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise
from .components import components
from .textstats import window_hashes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 4
#: Classes in a block, about, and n-grams of all of them.
BLOCK = 256
BLOCK_GRAMS = 300_000
_COLUMNS = 1024


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima that a pair at the threshold shares with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class WordHashes(dict):
    """64-bit hash of each word; kept for words seen again, up to a bound. One for each task, so that no worker keeps it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int = WORDS, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all its words if they are fewer; none without words."""
    words = text.encode("utf-8", "replace").split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = WordHashes() if hashes is None else hashes
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        return window_hashes(np.append(ids, np.uint64(len(words))), len(words) + 1)
    return np.unique(window_hashes(ids, n))


@lru_cache
def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 2**63, (k, 1), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, (k, 1), np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mult, salt = _seeds(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            g = grams[None, at : at + 2048] ^ salt
            g *= mult
            least = np.minimum(least, g.min(1))
        h = np.zeros(bands, np.uint64)
        for col in least.reshape(bands, rows).T:
            h = (h ^ col) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def class_key(grams: np.ndarray) -> bytes | None:
    """128-bit key of the n-gram set; None for no n-grams."""
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), class key and band hashes of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = WordHashes()
        for b in batches:
            keys, hashes, sizes = [], [], []
            for t in b.column(2):
                g = shingles(t.as_py(), n, words)
                keys.append(class_key(g))
                sizes.append(len(g))
                hashes.append(band_hashes(g, bands, rows) if len(g) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "th", "cls", "bands", "n"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, cls binary, bands array<bigint>, n long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        words = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                grams = [shingles(t.as_py(), n, words) for t in whole.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([class_key(g) for g in grams], pa.binary()), pa.array([g.tobytes() for g in grams], pa.binary())], ["cls", "grams"])

    return docs.select("text").mapInArrow(run, "cls binary, grams binary").where("cls is not null")


def _verify(keys: list[bytes], sides: np.ndarray, grams: list[bytes], copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """links, linked documents and the group's local root of each class. sides: 0, 1, or 2 for a block with itself."""
    sets = [np.frombuffer(g, np.uint64) for g in grams]
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + _COLUMNS))
        m = np.zeros((len(sets), min(_COLUMNS, int(shared.sum()) - at)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m[a] @ m[b].T
    union = n[a][:, None] + n[b][None, :] - common
    linked = common >= threshold * union - 1e-6
    linked &= a[:, None] != b[None, :]
    links, docs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    links[a] += linked.sum(1)
    docs[a] += linked @ copies[b]
    if len(a) + len(b) == len(sets):  # two blocks: else the rows have counted both ways
        links[b] += linked.sum(0)
        docs[b] += linked.T @ copies[a]
    root = np.arange(len(sets))
    x, y = a[np.nonzero(linked)[0]], b[np.nonzero(linked)[1]]
    while len(x):
        old = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == old).all():
            break
    return links, docs, root


def _verified(groups: DataFrame, threshold: float) -> DataFrame:
    """groups: (pair, side, cls, grams, copies) dealt and sorted by pair; one row per class and pair that has links."""

    def flush(rows):
        keys = [r[2] for r in rows]
        links, docs, root = _verify(keys, np.array([r[1] for r in rows]), [r[3] for r in rows], np.array([r[4] for r in rows]), threshold)
        at = np.flatnonzero(links)
        return [(keys[i], int(links[i]), int(docs[i]), keys[root[i]]) for i in at]

    def run(batches):
        rows, out = [], []
        for b in batches:
            for r in (tuple(x.as_py() for x in row) for row in zip(*b.columns, strict=True)):
                if rows and rows[0][0] != r[0]:
                    if len(rows) > 1:
                        out += flush(rows)
                    rows = []
                rows.append(r)
            if len(out) > 5000:
                yield batch(out)
                out = []
        if len(rows) > 1:
            out += flush(rows)
        yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())], ["cls", "links", "docs", "root"])

    return groups.mapInArrow(run, "cls binary, links long, docs long, root binary")


def near_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, th, class_id, text_class_id, n_copies, n_links, n_link_docs, first (the document that names the class)."""
    docs = docs.select("doc_id", "text")
    sig = materialise(signatures(docs, n, bands_for(threshold, recall, rows), rows), "signatures")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = materialise(sig.where("cls is not null").groupBy("cls").agg(F.min(name).alias("name"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("n").alias("n")), "classes")
    banded = classes.select("cls", F.posexplode("bands").alias("band", "hash"))
    buckets = materialise(banded.groupBy("band", "hash").agg(F.count("*").alias("size"), F.min("cls").alias("least")).where("size > 1").drop("size"), "buckets")  # written, so that the join can split a hot one
    members = materialise(banded.join(buckets.hint("merge"), ["band", "hash"]), "band-members")
    labels = materialise(members.groupBy("cls").agg(F.min("least").alias("label")), "labels")
    met = materialise(members.join(labels.hint("merge"), "cls").groupBy("band", "hash").agg(F.min("label").alias("met")), "band-labels")
    labels = members.select("band", "hash", "cls").join(met.hint("merge"), ["band", "hash"]).groupBy("cls").agg(F.hex(F.min("met")).alias("label"))
    sizes = labels.join(classes.select("cls", "n"), "cls").groupBy("label").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_GRAMS)).alias("parts"))
    sizes = materialise(sizes, "label-sizes")  # written, so that the join can split a hot label
    blocks = labels.join(sizes.hint("merge"), "label").select("cls", F.concat_ws("/", "label", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("block"))
    blocks = materialise(blocks, "blocks")
    seen = members.join(blocks, "cls").select("band", "hash", "block").distinct()
    pairs = seen.join(seen.withColumnRenamed("block", "other"), ["band", "hash"]).where("block <= other").select("block", "other").distinct()
    pairs = materialise(pairs, "block-pairs")
    known = classes.select("cls", "copies", F.col("name.doc_id").alias("doc_id")).join(blocks, "cls")
    reps = docs.join(known.select(F.col("doc_id").alias("rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    grams = _sets(reps, n).groupBy("cls").agg(F.first("grams").alias("grams")).join(known.select("cls", "copies", "block"), "cls")
    grams = materialise(grams, "gram-sets")
    deal = pairs.select(F.concat_ws("|", "block", "other").alias("pair"), F.explode(F.when(F.col("block") == F.col("other"), F.array(F.struct("block", F.lit(2).alias("side")))).otherwise(F.array(F.struct("block", F.lit(0).alias("side")), F.struct(F.col("other").alias("block"), F.lit(1).alias("side"))))).alias("x")).select("pair", "x.block", "x.side")
    groups = grams.join(deal, "block").select("pair", "side", "cls", "grams", "copies")
    groups = groups.repartitionByRange("pair").sortWithinPartitions("pair")  # by range: large groups do not meet in a task by chance
    links = materialise(_verified(groups, threshold), "links")
    counts = links.groupBy("cls").agg(F.sum("links").alias("n_links"), F.sum("docs").alias("linked"))
    roots = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    info = classes.select("cls", "name", "copies").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = materialise(info.groupBy("root").agg(F.min("name").alias("first")), "class-names")
    info = materialise(info.join(first.hint("merge"), "root").select("cls", "name", "first", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("linked", F.lit(0)).alias("linked")), "class-info")
    found = sig.select("doc_id", "th", "cls").join(info, "cls", "left")
    has = F.col("cls").isNotNull()
    return found.select(
        "doc_id",
        "th",
        F.when(has, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("name.doc_id")).otherwise(F.col("doc_id")).alias("text_class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_link_docs"),
        has.alias("has_words"),
        (~has | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).alias("first"),
    )


def keep_one_each(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near copies: of each class the document that names it stays; texts without words all stay."""
    k_id, k_th, k_words, th, one, own = fresh(docs, "k_id", "k_th", "k_words", "th", "one", "own")
    stay = near_join(docs, n, threshold).where("first").select(F.col("doc_id").alias(k_id), F.col("th").alias(k_th), F.col("has_words").alias(k_words)).distinct()
    rows = docs.withColumn(th, F.xxhash64("text"))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay[k_id]) & (rows[th] == stay[k_th]))
    rows = rows.withColumn(own, F.when(~F.col(k_words), F.monotonically_increasing_id()))  # texts without words all stay
    first = F.row_number().over(W.partitionBy(k_id, k_th, own).orderBy(th))
    return rows.withColumn(one, first).where(F.col(one) == 1).select(*docs.columns)  # each task keeps one row before the shuffle


#: DuckDB form: all pairs of different n-gram sets that share an n-gram, exactly.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN NULL WHEN len(ws) < 5 THEN [md5(array_to_string(ws, ' '))]
      ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' '))))) END AS gs FROM w),
k AS (SELECT doc_id, gs, CASE WHEN gs IS NOT NULL THEN md5(array_to_string(gs, ',')) END AS cls FROM g),
c AS (SELECT cls, min(doc_id) AS rep, count(*) AS copies, any_value(gs) AS gs FROM k WHERE cls IS NOT NULL GROUP BY cls),
u AS (SELECT rep, len(gs) AS n, unnest(gs) AS s FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.s = b.s AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, p.y FROM r JOIN p ON p.x = r.reach),
m AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node),
l AS (SELECT x, count(*) AS n_links, sum(copies) AS docs FROM p JOIN c ON c.rep = p.y GROUP BY x)
SELECT k.doc_id, coalesce(m.class_id, k.doc_id) AS class_id, coalesce(c.rep, k.doc_id) AS text_class_id, coalesce(c.copies, 1)::BIGINT AS n_copies,
       coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(coalesce(l.docs, 0) + c.copies - 1, 0)::BIGINT AS n_link_docs
FROM k LEFT JOIN c USING (cls) LEFT JOIN m ON m.node = c.rep LEFT JOIN l ON l.x = c.rep
"""
