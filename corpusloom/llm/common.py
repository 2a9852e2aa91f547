"""Scratch tables, Arrow helpers and bounds shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import shared_folder

#: Words are runs of anything but ASCII blanks and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

_SCRATCH = "loom-scratch"
_MADE = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Tables there last as long as results may read them; ``scratch_made`` tells which a
    block of code has made, for who knows that its results are written."""
    path = f"{shared_folder(spark)}/{_SCRATCH}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_MADE, "lists", []):
        made.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@contextmanager
def scratch_made() -> Iterator[list[str]]:
    """A list that gets the path of each scratch table made in this thread while the block runs."""
    lists = _MADE.__dict__.setdefault("lists", [])
    made: list[str] = []
    lists.append(made)
    try:
        yield made
    finally:
        lists[:] = [x for x in lists if x is not made]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, keep=None) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents, the same ones on each run.

    The rows are those with the smallest hash of their id; ``limit`` is the documented bound of all
    fitted models here. Rows without id, text or label are left out; repeated labels of an id count once
    (the largest), and of repeated documents one text is kept."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    if keep is not None:
        marked = marked.where(keep(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.join(docs.select("doc_id").dropna().distinct(), "doc_id", "left_semi")
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(picked), "doc_id")  # at most ``limit`` small rows
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def document_keys() -> tuple:
    """Two hashes that stand for a document (doc_id, text)."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")


def one_row_each(docs: DataFrame) -> DataFrame:
    """doc_id, text, _r1, _r2 (its keys) of each document, one row for rows that repeat doc_id and text, however many. Keys are
    counted first, and only rows that repeat are grouped."""
    one, two = document_keys()
    rows = docs.select("doc_id", "text", one.alias("_r1"), two.alias("_r2"))
    again = rows.groupBy("_r1", "_r2").agg(F.count("*").alias("copies")).where("copies > 1").select("_r1", "_r2")
    again = materialise(again, "repeated-rows")
    if again.isEmpty():
        return rows
    copies = rows.join(again.hint("merge"), ["_r1", "_r2"], "left_semi").groupBy("_r1", "_r2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return rows.join(again.hint("merge"), ["_r1", "_r2"], "left_anti").unionByName(copies)
