"""Running sums over a whole table, without a task that reads it all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the running sums of the given columns over the whole table, own row included, in an order without ties.

    Rows are dealt by ranges of the whole sort key, so a value of its first columns that very many rows have is split; each
    range is summed by itself and added to the sum of the ranges before it, of which there is one row each. write(df) writes
    and rereads a table, so that the ranges stay what they are."""
    part = "range"
    while part.lower() in {c.lower() for c in (*rows.columns, *sums)}:
        part += "_"
    dealt = write(rows.repartitionByRange(*order).select("*", *(c.alias(k) for k, c in sums.items()), F.spark_partition_id().alias(part)))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*(F.sum(k).alias(k) for k in sums))
    offsets = totals.select(part, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums))
    within = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.withColumns({k: F.sum(k).over(within) for k in sums}).join(F.broadcast(offsets), part)  # a row for each range
    return out.withColumns({k: F.col(k) + F.col(f"{k}_before") for k in sums}).drop(part, *(f"{k}_before" for k in sums))
