"""Change detection, upserts, deletions and parity of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.scratch import materialise


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key over both; of equal order values that of new wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc()))
    return both.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_new")


def unindexed(rows: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    return rows.join(indexed.select(key), key, "left_anti")


def first_of_equal(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order, so that the choice is not left to chance."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def same_file(scan: DataFrame) -> DataFrame:
    """scan (path, hash, mtime) with the first path that holds the same content. The first paths are written before they are
    joined, so that the join can split a content that very many paths hold."""
    first = materialise(scan.groupBy("hash").agg(F.min(F.struct("mtime", "path"))["path"].alias("first_path")))
    return scan.join(first, scan["hash"].eqNullSafe(first["hash"])).drop(first["hash"])


def file_changes(previous: DataFrame, scan: DataFrame) -> DataFrame:
    """path and status of each path of previous (path, content or its hash, mtime, status) or scan (path, content or its hash, mtime).

    In order: file_not_found, processing, then for new files duplicate_skipped or new_file, and for known ones
    unchanged, or retry_failed, modified, duplicate_skipped if the time moved or the last run failed."""
    hash_of = lambda files: F.col("hash") if "hash" in files.columns else T.sha256(F.col("content"))
    p = previous.select("path", hash_of(previous).alias("old_hash"), F.col("mtime").alias("old_mtime"), F.col("status").alias("old_status"))
    s = same_file(scan.select("path", hash_of(scan).alias("hash"), "mtime"))
    done = p.where("old_status = 'done'").groupBy(F.col("old_hash").alias("hash")).agg(F.min("path").alias("done_path"), F.max("path").alias("done_last"))
    x = p.join(s, "path", "full_outer").join(done, "hash", "left")
    elsewhere = F.col("done_path").isNotNull() & ((F.col("done_path") != F.col("path")) | (F.col("done_last") != F.col("path")))
    moved = F.abs(F.col("mtime") - F.col("old_mtime")) > 1e-3
    failed = F.col("old_status") == "failed"
    differs = F.col("hash") != F.col("old_hash")
    status = (
        F.when(F.col("hash").isNull(), "file_not_found")
        .when(F.col("old_status") == "processing", "processing")
        .when(F.col("old_status").isNull(), F.when(F.col("done_path").isNotNull() | (F.col("first_path") != F.col("path")), "duplicate_skipped").otherwise("new_file"))
        .when((F.col("old_status") == "skipped_duplicate") & ~moved, "duplicate_skipped")
        .when((moved | failed) & (differs | failed), F.when(elsewhere, "duplicate_skipped").when(failed, "retry_failed").otherwise("modified"))
        .otherwise("unchanged")
    )
    return x.select("path", status.alias("status"))


def crawl_delta(previous: DataFrame, now: DataFrame, url_hash: Column) -> DataFrame:
    """Per fetched URL whether it changed, the entity tag to keep and when it last changed."""
    p = previous.select(url_hash.alias("key"), T.sha256(T.noise_stripped(F.col("body"))).alias("old_hash"), F.col("etag").alias("old_etag"), "last_changed_s")
    n = now.select("url", url_hash.alias("key"), "http_status", T.sha256(T.noise_stripped(F.col("body"))).alias("hash"), "etag", "checked_s")
    x = n.join(p, "key", "left")
    status = F.when(F.col("http_status") == 304, "304_not_modified").when(F.col("old_hash").isNull(), "new_resource").when(F.col("hash") == F.col("old_hash"), "content_hash_unchanged").otherwise("content_modified")
    changed = status.isin("new_resource", "content_modified")
    return x.select("url", status.alias("status"), F.coalesce("etag", "old_etag").alias("etag"), F.when(changed, F.col("checked_s")).otherwise(F.col("last_changed_s")).alias("last_changed_s"))


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and indexed, changed or missing, by recomputed hashes."""
    f = files.select("path", T.sha256(F.col("content")).alias("now"))
    x = manifest.select("path", T.sha256(F.col("content")).alias("then")).join(f, "path", "left")
    return x.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("then"), "indexed").otherwise("changed").alias("state"))


def cascade_delete(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of ids (tables: name to rows and their key column), and rows removed and kept for each."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    left, counts = {}, []
    for name, (rows, column) in tables.items():
        left[name] = rows.join(gone, rows[column] == gone["_gone"], "left_anti")
        found = rows.join(gone, rows[column] == gone["_gone"], "left").agg(F.count("_gone").alias("removed"), F.count_if(F.col("_gone").isNull()).alias("kept"))
        counts.append(found.select(F.lit(name).alias("table_name"), "removed", "kept"))
    return left, reduce(DataFrame.unionByName, counts)


def any_branch(key: str, *branches: DataFrame) -> DataFrame:
    """Distinct keys of rows that one branch or more selects; each branch stays an equi join or a filter."""
    return reduce(DataFrame.union, [b.select(key) for b in branches]).distinct()


def parity(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Row counts of each table on both sides, whether they match, and whether all do."""
    count = lambda side, tables: reduce(DataFrame.union, [d.agg(F.count("*").alias(side)).select(F.lit(n).alias("table_name"), side) for n, d in tables.items()])
    x = count("source_rows", source).join(count("target_rows", target), "table_name", "full_outer")
    x = x.select("table_name", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("target_rows", F.lit(0)).alias("target_rows"))
    return x.withColumn("same", F.col("source_rows") == F.col("target_rows")).withColumn("all_same", F.expr("bool_and(same) over ()"))


def content_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each side has that the other lacks, with repeats."""
    sides = a.exceptAll(b).select(F.lit(1).alias("side")).union(b.exceptAll(a).select(F.lit(2)))
    return sides.agg(F.count_if(F.col("side") == 1).alias("only_source"), F.count_if(F.col("side") == 2).alias("only_target"))
