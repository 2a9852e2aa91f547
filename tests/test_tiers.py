"""Tiers in a snapshot table, URIs at three tiers, small talk, first courses."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import smalltalk
from corpusloom.operators import graph, lookups, reports
from corpusloom.operators.chunks import chunk
from corpusloom.plans.joins import TIERS
from corpusloom.sources.snapshots import SnapshotTable

DOCS = "document_id long, title string, department string, course string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "One", "d1", "c1", "Unit I: trees and more.\n\nThe process of growing is what we define as long enough a sentence here."), (2, "Two", "d1", "c2", None), (3, None, "d2", "c1", "x " * 2000), (12, "Twelve", "d1", "c1", "short")]
    return spark.createDataFrame(rows, DOCS).withColumn("tokens", F.coalesce(F.size(F.split("text", r"\s+")), F.lit(0)))


def nodes_of(docs):
    pieces = chunk(docs).select("document_id", "chunk_index", "text")
    return graph.tiers(docs.drop("text"), pieces), pieces


def test_texts_of_tiers(docs):
    by = {r["uri"]: r for r in nodes_of(docs)[0].collect()}
    assert len(by) == 4 + 3 + 2 + 1
    assert "**UNIT I**: trees and more" in by["tree://root/d1/c1/1"]["l1"] and by["tree://root/d1/c2/2"]["l1"] == "# tree://root/d1/c2/2"
    assert by["tree://root/d1/c1"]["l1"].endswith("## Documents\n- One\n- Twelve") and by["tree://root/d1"]["l1"].endswith("- c1: 2 documents\n- c2: 1 documents")
    assert by["tree://root"]["documents"] == 4 and by["tree://root"]["l1"].endswith("- d1: 3 documents\n- d2: 1 documents")


def test_sync_writes_changed_branches_alone(spark, docs, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/tiers", "uri", TIERS, 8)
    cast = lambda n: n.withColumns({"documents": F.col("documents").cast("long"), "tokens": F.col("tokens").cast("long"), "l0_tokens": F.col("l0_tokens").cast("long"), "l1_tokens": F.col("l1_tokens").cast("long")})
    assert {r["change"] for r in graph.sync_tiers(table, cast(nodes_of(docs)[0])).collect()} == {"new"}
    assert graph.sync_tiers(table, cast(nodes_of(docs)[0])).isEmpty() and table.pointer()["version"] == 1
    changed = docs.where("document_id <> 3").withColumn("title", F.when(F.col("document_id") == 12, "Dozen").otherwise(F.col("title")))
    got = {r["uri"]: r["change"] for r in graph.sync_tiers(table, cast(nodes_of(changed)[0])).collect()}
    assert got == {"tree://root/d1/c1/12": "changed", "tree://root/d1/c1": "changed", "tree://root/d2": "gone", "tree://root/d2/c1": "gone", "tree://root/d2/c1/3": "gone", "tree://root": "changed"}
    assert table.read().count() == 7


def test_resolve(spark, docs):
    nodes, pieces = nodes_of(docs)
    paths = graph.tree_paths(docs).select("uri", "parent_uri", "document_id")
    asked = ["tree://root/d1/c1/1/l2", "tree://root/d1/c1/1/l0", "tree://root/d1/c1", "tree://root/d2/c1/3/l2", "tree://root/d1/c2/2/l2", "tree://root/d2/l2", "tree://root/d1/c1/12/", "tree://none", "tree://root/d1/c1/l0/"]
    found = {r["asked"]: r for r in graph.resolve(spark.createDataFrame([(a,) for a in asked], "asked string"), nodes.join(paths, "uri"), pieces).collect()}
    assert set(asked) - set(found) == {"tree://none"}
    assert found["tree://root/d1/c1/1/l2"]["content"].startswith("[Page 1] Unit I") and found["tree://root/d1/c1/1/l0"]["content"] == "One, a document of c1 in d1"
    assert found["tree://root/d2/c1/3/l2"]["content"].count("\n\n---\n\n[Page ") == 2 and found["tree://root/d1/c2/2/l2"]["content"] == ""
    assert found["tree://root/d2/l2"]["content"].startswith("# Department d2") and found["tree://root/d1/c1/12/"]["uri"] == "tree://root/d1/c1/12"
    assert found["tree://root/d1/c1/l0/"]["content"].startswith("Course c1 in d1")


def test_first_courses(spark):
    rows = spark.createDataFrame([(f"d{i % 3}", f"c{i:03d}", 1) for i in range(60)] + [(None, "c", 1), ("d0", None, 1)], "department string, course string, tokens long")
    by = {(r["level"], r["department"], r["course"]): r for r in reports.hierarchy(rows).collect()}
    assert by[0, None, None]["courses"] == "c,c000,c001,c002,c003,c004,c005,c006" and by[0, None, None]["documents"] == 62
    assert by[1, "d1", None]["courses"].split(",") == [f"c{i:03d}" for i in range(1, 24, 3)]


SAID = {"Hello there!": "greeting", "hi, how r u": "greeting_and_how_are_you", "namaste ji kaise ho": "greeting_and_how_are_you", "what is today's date?": "date_time", "who are you": "identity", "आप कौन हैं": "identity", "help": "help", "how are you": "how_are_you", "koi joke sunao": "joke", "THX": "gratitude", "phir milenge": "farewell", "": "greeting", None: "greeting", "thanks for the fish": None, "hello, what is the fee": None}


def test_small_talk(spark):
    rows = spark.createDataFrame(list(SAID.items()), "q string, want string")
    assert [(r["q"], r["got"]) for r in rows.select("q", smalltalk.small_talk(F.col("q")).alias("got")).collect()] == list(SAID.items())
    asked = spark.createDataFrame([("the Vice-Chancellor",), ("CS 401",), ("23GEOD102DS02",), ("my affidavit",), ("tell a story",), (None,)], "q string")
    assert [r[0] for r in asked.select(smalltalk.institutional(F.col("q"))).collect()] == [True, True, True, True, False, False]


def test_repeats_across_slots(spark):
    rows = [("k", t) for t in (0, 3599, 3600, 7200, 7201, 20_000, 23_600, 27_201)] + [("other", 10)]
    got = lookups.earlier_repeats(spark.createDataFrame(rows, "key string, at long"), ["key"], "at", 3600).collect()
    assert sorted((r["at"], r["since_s"]) for r in got) == [(3599, 3599), (3600, 1), (7200, 3600), (7201, 1), (23_600, 3600)]
