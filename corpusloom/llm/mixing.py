"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by the md5 of their id) and queued twice over; a queued copy's virtual
finish time is the source's words up to and including it, divided by the source's target. Copies are range-sorted by
finish time over all sources, and the order is truncated where the total budget is used up.

All running sums, over sources, over the documents of a source and over the copies, are taken alike: rows are dealt by
ranges of the whole sort key, which differs for every row, so neither a large source nor a tie of many copies passes
through one task; each range is summed by itself and added to the sum of the ranges before it, a row for each range.

Defined cases: null or blank texts have size 0 and take nothing; very long texts count with all their words; a null source
is a source of its own, ordered last; rows with equal doc_id, source and size are one item that is taken whole per pass;
equal finish times are ordered by source, pass, md5 and doc_id; an empty table gives an empty result. Only doc_id, text and
source are read; ``take_mix`` gives the other columns back, and a column copy_no of docs is replaced. Reruns agree, as
nothing depends on row order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranges import running

from .common import WORD, fresh, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _table(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: materialise(df, name)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """rank, source, source_size, target and upto (words of the sources up to this one) from (source, source_size).

    Budget is shared by weight; sources ordered by cap/weight are capped one after another until the next one's
    cap is not below its share of what is left (water filling)."""
    s = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long"), "upto": F.col("source_size")}, _table("sources"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * passes)
    s = running(s.withColumn("at", F.col("cap") / F.col("w")), [F.col("at"), F.col("rank")], {"caps": F.col("cap"), "ws": F.col("w").cast("long")}, _table("caps"))
    total, w = s.agg(F.sum("source_size"), F.sum("w")).first()
    lam = (F.lit(share * (total or 0)) - (F.col("caps") - F.col("cap"))) / (F.lit(w or 1) - (F.col("ws") - F.col("w")))
    free = s.withColumn("lam", lam).where(F.col("at") >= F.col("lam")).agg(F.min(F.struct("at", "rank", "lam"))).first()[0]
    level = F.lit(free["lam"] if free else None).cast("double")
    return s.select("rank", "source", "source_size", F.when(F.col("at") >= level, level * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"), "upto")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies for each row of docs."""
    d = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    goals = materialise(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes), "targets")
    items = d.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    items = items.join(goals, items["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    items = items.select("doc_id", "source", "size", "m", "rank", "source_size", "target", (F.col("upto") - F.col("source_size")).alias("before"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))
    queued = running(items, [F.col(c) for c in ("rank", "key", "doc_id", "size")], {"upto": F.col("size") * F.col("m")}, _table("items"))
    queued = materialise(queued.withColumn("upto", F.col("upto") - F.col("before")).drop("before"), "queued")

    def finish(k: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("upto") + k * F.col("source_size")) / F.col("target"))

    copies = queued.where("size > 0").select("rank", "key", "doc_id", (F.col("size") * F.col("m")).alias("words"), F.posexplode(F.array(*(finish(k) for k in range(passes)))).alias("pass", "f")).where("f is not null")
    order = ("f", "rank", "pass", "key", "doc_id")
    used = running(copies, [F.col(c) for c in order], {"used": F.col("words")}, _table("copies"))
    total = d.agg(F.sum("size")).first()[0]
    cut = used.where(F.col("used") <= share * (total or 0)).agg(F.max(F.struct(*order))).first()[0]
    if cut is None:
        count = F.lit(0)
    else:
        end = F.struct(*(F.lit(cut[c]).cast(copies.schema[c].dataType).alias(c) for c in order))
        count = sum((F.when(F.struct(finish(k).alias("f"), "rank", F.lit(k).alias("pass"), "key", "doc_id") <= end, 1).otherwise(0) for k in range(passes)), F.lit(0))
        count = F.when((F.col("size") > 0) & (F.col("target") > 0), count).otherwise(0)
    q = queued.select(F.col("doc_id").alias("q_id"), F.col("source").alias("q_source"), F.col("size").alias("q_size"), "source_size", "target", count.cast("int").alias("copies"))
    same = d["doc_id"].eqNullSafe(q["q_id"]) & d["source"].eqNullSafe(q["q_source"]) & (d["size"] == q["q_size"])
    return d.join(q, same).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """The mix itself: each taken row of docs with its columns, once for each copy, and the copy's number as ``copy_no``."""
    docs = docs.drop("copy_no")
    p_id, p_source, p_size, p_copies, size = fresh(docs, "p_id", "p_source", "p_size", "p_copies", "words")
    plan = mix(docs, weights, share, passes).where("copies > 0").select("doc_id", "source", "size", "copies").distinct()
    plan = plan.select(F.col("doc_id").alias(p_id), F.col("source").alias(p_source), F.col("size").alias(p_size), F.col("copies").alias(p_copies))
    rows = docs.withColumn(size, word_count(F.col("text")))
    same = rows["doc_id"].eqNullSafe(plan[p_id]) & rows["source"].eqNullSafe(plan[p_source]) & (rows[size] == plan[p_size])
    return rows.join(plan, same).select(*(rows[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(p_copies))).alias("copy_no"))


#: DuckDB form of ``mix``, by plain windows.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0))::DOUBLE AS lam
       FROM s2 WINDOW o AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(lam, (cap::DOUBLE / w, rank)) AS level FROM s3 WHERE cap::DOUBLE / w >= lam),
g AS (SELECT rank, source, source_size, CASE WHEN cap::DOUBLE / w >= level THEN level * w ELSE cap::DOUBLE END AS target FROM s3, lv),
q AS (SELECT d.doc_id, d.size, g.rank, g.source_size, g.target, md5(d.doc_id::VARCHAR) AS k,
      sum(d.size) OVER (PARTITION BY g.rank ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT q.*, p.pass, (upto + p.pass * source_size)::DOUBLE / target AS f FROM q, (VALUES (0), (1)) p(pass) WHERE size > 0 AND target > 0),
t AS (SELECT doc_id, size, sum(size) OVER (ORDER BY f, rank, pass, k, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM t WHERE used <= 1.5 * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)
"""
