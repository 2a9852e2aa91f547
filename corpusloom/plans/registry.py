"""Registry of queries: each has a name, a Spark form over an ``Inputs`` object, and mostly a DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Inputs:
    """Tables and derived views of one input folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        needs, text = VIEWS[name]
        return self.spark.sql(text, **{n: self(n) for n in needs})


def query(name: str, sql: str | None = None):
    """Register a function of Inputs. sql: DuckDB text that may use the derived views by name."""

    def put(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return put
