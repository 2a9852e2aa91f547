"""Short and long synopses of documents from their chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Headings of units, formulas and named laws, and words of a sentence that defines something.
UNIT = r"(?i)\b(unit\s+[ivxlcdm0-9]+|chapter\s+[0-9]+|module\s+[0-9]+)\b[:\s\-]*([^\n.]+)"
FORMULA = r"(\$[^$]+\$|O\([1nlog\s]+\)|[A-Z][a-z]+'s Algorithm|[A-Z][a-z]+ Law)"
CONCEPT = "define|algorithm|process|rule|protocol|architecture"


def _first(found: DataFrame, n: int, line: Column, name: str) -> DataFrame:
    """document_id and the lines of its first n distinct items (document_id, item, at: where it stands)."""
    one = found.groupBy("document_id", "item").agg(F.min("at").alias("at"))
    top = one.withColumn("k", F.row_number().over(W.partitionBy("document_id").orderBy("at"))).where(F.col("k") <= n)
    return top.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias(name))


def synopses(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, l0, l1 and their numbers of tokens for documents (document_id, title, department, course) that have chunks
    (document_id, chunk_index, text): l0 is a sentence, l1 lists the first six units, six formulas and four defining sentences."""
    c = chunks.select("document_id", "chunk_index", F.coalesce("text", F.lit("")).alias("text"))
    unit = F.concat(F.lit("**"), F.upper(F.regexp_extract("text", UNIT, 1)), F.lit("**: "), F.left(T.stripped(F.regexp_extract("text", UNIT, 2)), F.lit(70)))
    units = c.where(F.col("text").rlike(UNIT)).select("document_id", unit.alias("item"), F.struct("chunk_index", F.lit(0).alias("i")).alias("at"))
    formulas = c.select("document_id", "chunk_index", F.posexplode(F.regexp_extract_all("text", F.lit(FORMULA), F.lit(1))).alias("i", "item")).where(F.length("item") > 3)
    sentences = F.slice(F.filter(F.transform(F.split("text", r"\."), T.stripped), lambda x: F.length(x) > 35), 1, 2)
    concepts = c.select("document_id", "chunk_index", F.posexplode(sentences).alias("i", "item")).where(F.lower("item").rlike(CONCEPT))
    placed = lambda d: d.select("document_id", "item", F.struct("chunk_index", "i").alias("at"))
    lists = (
        _first(units, 6, F.concat(F.lit("- "), "item"), "units"),
        _first(placed(formulas), 6, F.concat(F.lit("- `"), "item", F.lit("`")), "formulas"),
        _first(placed(concepts), 4, F.concat(F.lit('- *"'), F.left("item", F.lit(140)), F.lit('"*')), "concepts"),
    )
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    x = reduce(lambda a, b: a.join(b, "document_id", "left"), lists, documents.join(n, "document_id"))
    l0 = F.concat(F.lit("Material of "), F.coalesce("department", F.lit("General")), F.lit(", course "), F.coalesce("course", F.lit("General")), F.lit(", titled "), "title", F.lit(", in "), F.col("chunks").cast("string"), F.lit(" parts."))
    part = lambda head, body: F.concat(F.lit(f"\n## {head}\n"), body)
    l1 = F.concat(F.lit("# "), "title", F.lit("\n"), "l0", part("Units", F.coalesce("units", F.lit("- No units named."))), F.coalesce(part("Formulas", F.col("formulas")), F.lit("")), part("Concepts", F.coalesce("concepts", F.lit("- No concepts defined."))))
    x = x.withColumn("l0", l0).select("document_id", "l0", l1.alias("l1"))
    return x.select("*", T.words_estimate(F.col("l0")).alias("l0_tokens"), T.words_estimate(F.col("l1")).alias("l1_tokens"))
