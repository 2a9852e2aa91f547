"""Sources and sinks: files, pages, JSON sets, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of binary kinds.
MAGIC = {"pdf": b"%PDF-", "zip": b"PK\x03\x04", "rar": b"Rar!", "7z": b"7z\xbc\xaf\x27\x1c", "gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "exe": b"MZ"}
MAX_BYTES = 5_000_000
EXTENSIONS = ("pdf", "docx", "doc", "txt", "md")


def sniff(body: Column) -> Column:
    """Kind of a binary payload by its first bytes, else 'text'."""
    return F.coalesce(*(F.when(F.substring(body, 1, len(m)) == F.lit(bytearray(m)), k) for k, m in MAGIC.items()), F.lit("text"))


def html_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """pages whose body is text of at most MAX_BYTES bytes, with it decoded as text."""
    c = F.col(body)
    text = F.regexp_replace(F.decode(c, "UTF-8"), "^﻿", "")
    return pages.where((F.octet_length(c) <= MAX_BYTES) & (sniff(c) == "text")).withColumn("text", text).drop(body)


def scan_files(spark: SparkSession, folder: str, extensions=EXTENSIONS) -> DataFrame:
    """path, modificationTime, length and content of the files below a folder, by ending."""
    glob = "*.{" + ",".join(extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def text_pages(files: DataFrame) -> DataFrame:
    """path, page_number and stripped text of text and markdown files of ``scan_files``, one page a file."""
    return files.where(F.col("path").rlike(r"\.(?:txt|md)$")).select("path", F.lit(1).alias("page_number"), F.regexp_replace(F.decode("content", "UTF-8"), r"^\s+|\s+$", "").alias("text"))


def json_set(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def copy_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write each table as a Parquet snapshot below folder; returns them read back."""
    out = {}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")
    return out
