"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines with words are hashed and numbered within their document. From each line on, the shortest run of lines with ``min_words`` words
is a window, and so is the shortest run that ends with each line. Every run of whole lines that two places share and that has
``min_words`` words holds such a window at its first line and one at its last, so the window's minimal line hash, its
fingerprint, is selected in both places (the guarantee of winnowing).

Fingerprints found at one place only go. Of the others each place is joined with the first place that has the fingerprint in the
same surroundings (the window's content), so that a line that stands everywhere meets one place for each of its surroundings and
not all others. Such a pair of places is a seed: from it the hashes of the lines before and behind are compared outwards, both
ways, until they differ; if what matches has ``min_words`` words, the later place is deleted. Two places of one document may not
overlap; a match that would is cut to its windows.

So a line goes exactly if it lies in a run of consecutive lines, ``min_words`` words or more, that stands earlier:
in a document with a smaller doc_id, or further up without overlap. Lines are compared by two 64-bit hashes,
lines without a word are left out of runs, but go if they stand inside a deleted one.

Defined cases: null texts stay null, empty ones empty; a null doc_id comes first in the order; rows with the same
doc_id and text are one document (made one row before lines are taken, so that any number of them is one document's work) and get
the same result; very long texts are taken whole; of runs that tie for the first place the least doc_id, then the least line
counts; an empty table gives an empty result. Columns of any other name are given back, but for those named as an output. Passages that
a third of all documents share meet only as one row for each place joined with a single first place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, document_keys, fresh, materialise, one_row_each

MIN_WORDS = 50


def _lines(once: DataFrame) -> DataFrame:
    """The lines with words of each document, as an array of pos (in the text), h, h2 and wc (words)."""
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("wc")))
    return once.where("text is not null").select("doc_id", "_r1", "_r2", F.filter(every, lambda x: x["wc"] > 0).alias("lines"))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each window: document, first and last line, fingerprint (hash and line), content hash. Lines are numbered from 0."""
    rows = lines.select("doc_id", "_r1", "_r2", F.posexplode("lines").alias("i", "line")).select("doc_id", "_r1", "_r2", "i", "line.h", "line.h2", F.col("line.wc").cast("long").alias("wc"))
    doc = W.partitionBy("_r1", "_r2")
    rows = rows.withColumn("upto", F.sum("wc").over(doc.orderBy("i").rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("wc"))

    def window(frame, reach):
        return F.struct(reach.over(frame).alias("reach"), F.sum("wc").over(frame).alias("words"), F.min(F.struct("h", "i")).over(frame).alias("fp"), F.collect_list(F.struct("h", "h2")).over(frame).alias("content"))

    rows = rows.withColumn("right", window(doc.orderBy("before").rangeBetween(0, min_words - 1), F.max("i")))
    rows = rows.withColumn("left", window(doc.orderBy("upto").rangeBetween(1 - min_words, 0), F.min("i")))

    def own(start, end, side):
        return F.struct(start.alias("start"), end.alias("end"), F.col(f"{side}.words").alias("words"), F.col(f"{side}.fp").alias("fp"), F.xxhash64(f"{side}.content").alias("content"))

    new = F.col("left.words") - F.col("wc") >= min_words  # else it is its first line's own window
    right, left = own(F.col("i"), F.col("right.reach"), "right"), own(F.col("left.reach"), F.col("i"), "left")
    both = rows.select("doc_id", "_r1", "_r2", F.explode(F.when(new, F.array(right, left)).otherwise(F.array(right))).alias("w")).where(F.col("w.words") >= min_words)
    return both.select("doc_id", "_r1", "_r2", "w.start", "w.end", F.col("w.fp.h").alias("fp"), F.col("w.fp.i").alias("at"), "w.content")


def _surroundings(shared: DataFrame, lines: DataFrame) -> DataFrame:
    """For each place of a shared fingerprint (_r1, _r2, at) the lines behind it, itself first, and those before it, the nearest first,
    as far as windows that selected it reach."""
    spots = shared.groupBy("_r1", "_r2", "at").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    of_doc = spots.groupBy("_r1", "_r2").agg(F.collect_list(F.struct("at", "low", "high")).alias("spots"))
    x = lines.join(of_doc, ["_r1", "_r2"]).select("_r1", "_r2", "lines", F.explode("spots").alias("s"))
    behind = F.slice("lines", F.col("s.at") + 1, F.col("s.high") - F.col("s.at") + 1)
    before = F.reverse(F.slice("lines", F.col("s.low") + 1, F.col("s.at") - F.col("s.low")))
    return materialise(x.select("_r1", "_r2", "s.at", behind.alias("behind"), before.alias("before")), "line-surroundings")


def _matching(a: Column, b: Column) -> Column:
    """How many lines two arrays share from their beginning on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["h2"] == y["h2"]), F.lit(False)))
    end = F.array_position(same, False)
    return F.when(end == 0, F.size(same)).otherwise(end - 1).cast("int")


def _seeds(shared: DataFrame) -> DataFrame:
    """Each pair of a later place (_r1, _r2, at) and a first one (f1, f2, first_at) once, and how far its windows reach (low, high)."""
    place = F.struct("doc_id", "_r1", "_r2", "start", "end", "at")
    first = shared.groupBy("fp", "content").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("fp", "content", "first")
    first = materialise(first, "first-places")
    later = shared.join(first.hint("merge"), ["fp", "content"])
    same_doc = (F.col("_r1") == F.col("first._r1")) & (F.col("_r2") == F.col("first._r2"))
    later = later.where(F.when(same_doc, F.col("start") > F.col("first.end")).otherwise(F.lit(True)))
    pairs = later.groupBy("_r1", "_r2", "at", F.col("first._r1").alias("f1"), F.col("first._r2").alias("f2"), F.col("first.at").alias("first_at"))
    return materialise(pairs.agg(F.min("start").alias("low"), F.max("end").alias("high")), "line-seeds")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_r1, _r2 (a document's keys), start and end (lines of the text) of each run of lines that stands earlier."""
    lines = _lines(one_row_each(docs))
    win = materialise(windows(lines, min_words), "line-windows")
    spot = F.xxhash64("_r1", "_r2", "at")
    prints = win.groupBy("fp").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("fp")
    prints = materialise(prints, "fingerprints")  # written, so that the joins can split hot keys; never broadcast, as it grows
    shared = win.join(prints.hint("merge"), "fp", "left_semi")
    seeds, around = _seeds(shared), _surroundings(shared, lines)
    theirs = around.select(F.col("_r1").alias("f1"), F.col("_r2").alias("f2"), F.col("at").alias("first_at"), F.col("behind").alias("their_behind"), F.col("before").alias("their_before"))
    x = seeds.join(around.hint("merge"), ["_r1", "_r2", "at"]).join(theirs.hint("merge"), ["f1", "f2", "first_at"])
    x = x.withColumns({"down": _matching(F.col("behind"), F.col("their_behind")), "up": _matching(F.col("before"), F.col("their_before"))})
    # Within one document a match may not overlap its source: one that would is cut to the windows, of which none does.
    same_doc = (F.col("_r1") == F.col("f1")) & (F.col("_r2") == F.col("f2"))
    overlaps = same_doc & (F.col("down") + F.col("up") > F.col("at") - F.col("first_at"))
    x = x.withColumns({"down": F.when(overlaps, F.least("down", F.col("high") - F.col("at") + 1)).otherwise(F.col("down")), "up": F.when(overlaps, F.least("up", F.col("at") - F.col("low"))).otherwise(F.col("up"))})
    down, up = F.slice("behind", 1, F.col("down")), F.slice("before", 1, F.col("up"))
    words = F.aggregate(F.concat(up, down), F.lit(0).cast("long"), lambda a, y: a + y["wc"])
    runs = x.where(words >= min_words).select("_r1", "_r2", F.when(F.col("up") > 0, F.element_at(up, -1)["pos"]).otherwise(F.col("behind")[0]["pos"]).alias("start"), F.element_at(down, -1)["pos"].alias("end"))
    return _merged(runs)


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of each document with those that overlap made one."""
    order = W.partitionBy("_r1", "_r2").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("new", (F.coalesce(F.col("start") > reach + 1, F.lit(True))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("_r1", "_r2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text_out: str = "text", removed_out: str = "n_removed", lines_out: str = "n_lines") -> DataFrame:
    """The rows of docs with the text without repeated runs, the number of \\n-split lines before, and of lines removed.

    Columns of docs named as an output are replaced by it."""
    runs, k1, k2 = fresh(docs, "runs", "k1", "k2")
    found = repeated_runs(docs, min_words).groupBy(F.col("_r1").alias(k1), F.col("_r2").alias(k2)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(runs))
    one, two = document_keys()
    rows = docs.withColumns({k1: one, k2: two}).join(found, [k1, k2], "left")
    lines = F.split("text", "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["start"] - 1), F.array(F.size(lines) - 1))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s + 1)))
    removed = F.aggregate(runs, F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1)
    outs = {text_out: F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")), lines_out: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), removed_out: F.coalesce(removed, F.lit(0)).cast("long")}
    return rows.select(*(F.col(f"`{c}`") if c not in outs else outs.pop(c).alias(c) for c in docs.columns), *(v.alias(k) for k, v in outs.items()))


#: DuckDB form, without fingerprints: every window is compared by its text.
SQL = r"""
WITH l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l0 WHERE text IS NOT NULL),
l2 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS wc FROM l1),
l3 AS (SELECT *, sum(wc) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS upto FROM l2 WHERE wc > 0),
l4 AS (SELECT *, upto - wc AS before FROM l3),
w AS (
  SELECT doc_id, pos AS s, max(pos) OVER f AS e, sum(wc) OVER f AS n, string_agg(line, chr(10)) OVER f AS c FROM l4
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, pos, sum(wc) OVER b, string_agg(line, chr(10)) OVER b FROM l4
  WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
x AS (SELECT * FROM w WHERE n >= 50),
f AS (SELECT c, min((doc_id, s, e)) AS first FROM x GROUP BY c),
m AS (SELECT x.doc_id, s, e FROM x JOIN f USING (c) WHERE (x.doc_id = struct_extract(first, 1) AND s > struct_extract(first, 3)) OR x.doc_id <> struct_extract(first, 1)),
gone AS (SELECT DISTINCT l1.doc_id, l1.pos FROM l1 JOIN m ON l1.doc_id = m.doc_id AND l1.pos BETWEEN m.s AND m.e),
k AS (SELECT l1.doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
      FROM l1 LEFT JOIN gone g USING (doc_id, pos) GROUP BY l1.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""
