"""Joins beyond plain equality: as-of, prefix, first match, time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_before(rows: DataFrame, by: list[str], order: list[Column], value: Column, wanted: Column, name: str) -> DataFrame:
    """Rows that are wanted, each with the latest value that is not null at or before it: an as-of join in one window."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w)).where(wanted)


def by_prefix(folders: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """folders (path) with the number of rows at or below each; every row is counted once per ancestor by an equi join."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    counts = rows.select(F.explode(ancestors).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return folders.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def glob_regex(pattern: Column) -> Column:
    """Regular expression of a glob with * and ?, anchored at both ends."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


#: Rules that are compared with every url; more are met by the head of their pattern.
FEW_RULES = 1000
_HEAD = 24


def first_rule(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Each distinct url with the action and id of the newest rule (rule_id, pattern, action) that fits it, as a glob or
    as a literal prefix.

    A short table of rules is counted and sent to all tasks. A longer one is joined on the literal head of the pattern, of
    which a url has at most 25; patterns that begin with a wildcard have the empty head and meet every url either way."""
    fits = F.rlike(F.col(url), F.col("rx")) | F.startswith(F.col(url), F.col("pattern"))
    r = rules.withColumn("rx", glob_regex(F.col("pattern")))
    u = urls.select(url).distinct()
    if rules.count() <= FEW_RULES:
        met = u.join(F.broadcast(r), fits)
    else:
        heads = F.transform(F.sequence(F.lit(0), F.least(F.length(url), F.lit(_HEAD))), lambda n: F.left(F.col(url), n))
        r = r.withColumn("head", F.left(F.regexp_extract("pattern", r"^([^*?]*)", 1), F.lit(_HEAD)))
        met = u.withColumn("head", F.explode(heads)).join(r, "head").where(fits)
    best = met.groupBy(F.col(url).alias("met")).agg(F.max(F.struct("rule_id", "action")).alias("b"))
    return u.join(best, F.col(url) == F.col("met"), "left").select(url, F.coalesce("b.action", F.lit(default)).alias("action"), F.col("b.rule_id").cast("long").alias("rule_id"))


def earlier_repeats(rows: DataFrame, key: list[str], at: str, ttl_s: int) -> DataFrame:
    """Rows that repeat a key within ttl_s seconds of its row before, and how long before.

    Time is cut into slots of ttl_s, so that a key that very many rows have is many windows: the row before stands in the same slot,
    or it is the last one of the slot before."""
    x = rows.withColumn("_slot", F.floor(F.col(at) / ttl_s))
    last = x.groupBy(*key, (F.col("_slot") + 1).alias("_slot")).agg(F.max(at).alias("_last"))
    before = F.lag(at).over(W.partitionBy(*key, "_slot").orderBy(at))
    x = x.withColumn("_before", before).join(last, [*key, "_slot"], "left")
    return x.withColumn("since_s", F.col(at) - F.coalesce("_before", "_last")).where(F.col("since_s") <= ttl_s).drop("_slot", "_before", "_last")


def sliding_count(rows: DataFrame, by: str, at: Column, seconds: int) -> Column:
    """Attempts of a client in the last seconds up to a row, itself included, as a column for select."""
    return F.count("*").over(W.partitionBy(by).orderBy(at).rangeBetween(1 - seconds * 1_000_000, 0))


def islands(rows: DataFrame, by: str, at: Column, gap_s: int) -> DataFrame:
    """Sessions of inactivity: by, start, end and number of rows."""
    w = W.partitionBy(by).orderBy("_at")
    x = rows.withColumn("_at", at)
    x = x.withColumn("_new", (F.coalesce(F.col("_at") - F.lag("_at").over(w), F.lit(gap_s)) >= gap_s).cast("int"))
    x = x.withColumn("_s", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(by, "_s").agg(F.min("_at").alias("start_s"), F.max("_at").alias("end_s"), F.count("*").alias("n")).drop("_s")
