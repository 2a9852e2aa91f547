"""Lists: search, pages, previews, balanced samples, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_scope(rows: DataFrame, **scope: str | None) -> DataFrame:
    """Rows equal to each given value; None, 'all' and '' stand for no filter."""
    for column, value in scope.items():
        if value and value.lower() != "all":
            rows = rows.where(F.col(column) == value)
    return rows


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring search over columns; wildcards in the needle are literal."""
    pattern = "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return found


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows in order, with the total and the number of pages."""
    total = rows.agg(F.count("*")).scalar()
    found = rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)
    return found.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", start: int = 0) -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1 + start).cast("long"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 0; Spark prunes before the shuffle."""
    return numbered(rows, by, order, name).where(F.col(name) < k)


def balanced(rows: DataFrame, by: str, order: list[str], each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group, then filled up from the rest to ``total`` in order; order: columns without ties.

    The first of each group are found by a pruned top-k. If they do not fill up, all the rest that can stand among the
    first 2 x total rows, so no group is ever numbered whole."""
    first = top_k(rows, [by], [F.col(c) for c in order], each, "_late").withColumn("_late", F.lit(False))
    head = rows.orderBy(*order).limit(2 * total)
    rest = head.join(first.select(*order), order, "left_anti").withColumn("_late", F.lit(True)).select(*first.columns)
    return first.unionByName(rest).orderBy("_late", *order).limit(total).drop("_late")


def capped_flags(rows: DataFrame, by: list[str], order: list[Column], flag: Column, most: int) -> DataFrame:
    """Rows without those flagged beyond the first ``most`` of a group."""
    seen = F.sum(flag.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).where(~flag | (F.col("_seen") <= most)).drop("_seen")
