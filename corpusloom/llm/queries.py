"""Registered queries of the training-data operators: thin callers, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, language_id, line_dedup, mixing, near_join, pii, quality_gam, quality_rules, toxicity, url_rules, variants, warc, whitening
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline at the repository top."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op2_source_mix"] = mixing.SQL


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE["op3_line_dedup"] = line_dedup.SQL


@query
def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join.near_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "text_class_id", "n_copies", "n_links", "n_link_docs")


ORACLE["op5_near_join"] = near_join.SQL


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op6_decontamination"] = decontam.SQL


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index, folder = warc.archive_pages(pages)
    return warc.read_records(index, folder, payloads=False, page_id=pages.schema["page_id"].dataType.simpleString())


ORACLE["op10_warc"] = warc.SQL


@query
def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.classify(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents"))

    def n(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(n, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op11_spelling_variants"] = variants.SQL


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
