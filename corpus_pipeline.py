"""Training corpus pipeline: documents to a mixed, clean corpus in five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; n_chars follows the text where a stage changes it.

Defined cases, besides those of the operators: docs needs doc_id, text and (for the mix) source, n_chars may lack, and any
other columns are given back as they were; columns named like a work column of an operator do not matter. Rows are kept or
dropped one by one, so repeated rows are no error; an empty table gives an empty one at every stage.

Scratch tables of a stage go when the next one is called from the same thread, as its input is written by then; those that
the next one's input still reads stay. ``run`` also removes each stage's output when the next one is written."""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, line_dedup, mixing, near_join, quality_rules
from corpusloom.llm.common import delete_path, fresh, scratch_made, scratch_path, table

_LEFT = threading.local()


def _stage(f):
    """Delete the scratch tables of the stage before, unless docs still reads them, and note those of this one."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.__dict__.pop("paths", [])
        if left:
            read = docs.inputFiles()
            for path in left:
                name = path.rsplit("/", 1)[-1]
                if not any(name in x for x in read):
                    delete_path(spark, path)
        with scratch_made() as made:
            out = f(spark, docs, sf_dir)
        _LEFT.paths = made
        return out

    return stage


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those under the floor (null, empty and short texts among them) and those
    that the trees score low. Trees are fitted on the labelled rows of docs; without labels the floor alone decides."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier are cut out; a document of which no word is left goes. Texts that were null, empty or
    blank before stay; rows that repeat doc_id and text are cut alike."""
    removed, lines = fresh(docs, "removed", "lines")
    cut = line_dedup.dedup_lines(docs, removed_out=removed, lines_out=lines)
    left = (F.col(removed) == 0) | (mixing.word_count(F.col("text")) > 0)
    return _measured(cut.where(left).drop(removed, lines))


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; of rows that repeat it, one. Texts
    without a word all stay."""
    return near_join.keep_one_each(docs)


@_stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; every document stays, also one that is empty then."""
    return _measured(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


@_stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each copy that is taken, numbered by copy_no. Texts without words are not taken;
    a null source is a source of its own."""
    return mixing.take_mix(docs)


STAGES = [("quality rules", rule_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", benchmark_stage), ("mixing sources", mix_stage)]

#: SQL cannot express the fitted trees of the first stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    home = scratch_path(spark, "stage").replace("loom-scratch", "loom-stages")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{home}-{k}"
        df = stage(spark, docs, sf_dir)
        df.write.parquet(out)
        docs = spark.read.schema(df.schema).parquet(out)
        if k:
            delete_path(spark, f"{home}-{k - 1}")
    return docs
