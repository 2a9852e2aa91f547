"""Queries and operators do the whole job: no rows, texts or terms left out."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search
from corpusloom.queries import ORACLE, QUERIES

from .oracle import connect, same


def test_scan_keeps_all_rows_and_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n = lambda x: tuple(x.agg(F.count("*"), F.sum(F.length("text"))).first())
    assert n(d)[0] > 100
    assert n(QUERIES["a1_scan_whole"](spark, sf)) == n(d)


def test_boosts_of_search(spark):
    """Literal cases: each boost alone, two of them for chunks that share no token with the query."""
    queries = {1: "exam fee hostel", 2: "court meeting", 3: "semester 7", 4: "about CS-401", 5: "seventh notes", 6: "senate zebra"}
    docs = {1: ("a", "exams fees hostels"), 2: ("Court minutes", "x"), 3: ("Seventh list", "x"), 4: ("b", "paper CS 401"), 5: ("c", "the 7th"), 6: ("Senate gazette", "senate zebra zebra"), 7: ("First list", "semester")}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    c = spark.createDataFrame([(i, t, "x", x) for i, (t, x) in docs.items()], "chunk_id long, title string, course string, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25_boosted(q, c).collect()}
    plain = {(r.query_id, r.chunk_id): r.score for r in search.bm25(q, c.select("chunk_id", F.concat_ws(" ", "title", "text").alias("text"))).collect()}
    assert got[1, 1] == 35 and (1, 1) not in plain
    assert round(got[2, 2] - plain[2, 2], 6) == 8
    assert got[3, 3] == 10 and (3, 7) not in got and (3, 7) in plain
    assert got[4, 4] == 15 and (4, 4) not in plain
    assert got[5, 5] > 3 and (5, 5) not in plain
    assert round(got[6, 6] - plain[6, 6], 6) == 35 + 8 - 25


def test_boosted_search_equals_sql_on_planted_rows(spark, tmp_path):
    queries = ["exam fee hostel", "the court in session 2", "semester 7 notes", "about CS-401 and CS-401", "seventh second notes", "senate zebra gazette", "who is the"]
    docs = ["exams fees hostels", "Court minutes of the second", "Seventh list", "paper CS 401", "notes, the 7th", "Senate gazette zebra", "First list of a semester", "who is zebra", "annual exam of the syndicate: court", "plain zebra notes"]
    spark.createDataFrame(list(enumerate(queries)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, x, "en", "src1", len(x)) for i, x in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(QUERIES["bm25_search_boosted"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE["bm25_search_boosted"]) is None


def test_whole_texts(spark, sf, tmp_path):
    """Words behind 2,000 and 4,000 characters count."""
    long = "x " * 2500 + "the und hostel"
    spark.createDataFrame([(0, long, "en", "src1", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "y" * 500 + " end")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "y" * 500 + " end")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).first()
    assert (run("h22_language_markers_whole").n_en, run("h22_language_markers_whole").n_de) == (1, 1)
    assert "y end" in run("h2_query_normalised_whole").q and "y end" in run("h4_answer_cleaned").t and "y end" in run("h5_fenced_context_whole").context


def test_hybrid_embeds_whole_texts(spark, tmp_path):
    docs = [(0, "x " * 2500 + "alpha beta gamma " * 1500), (1, "x " * 2500 + "other words")]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.chunk_id: r.dense_score for r in QUERIES["k4_hybrid"](spark, str(tmp_path)).collect()}
    assert any(score and score > 0 for chunk, score in got.items() if 0 < chunk < 10_000)  # chunks of document 0 behind its first


def test_repeat_questions_by_whole_text(spark, tmp_path):
    said = [(1, 0, "user", "When is the exam?"), (1, 1, "user", "When is the fee due?"), (1, 2, "assistant", "When is the exam?"), (1, 3, "user", "  when is the EXAM? ")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in QUERIES["i8_repeat_questions_whole"](spark, str(tmp_path)).collect()] == [(103, 180)]


def test_near_repeats_within_an_hour(spark, tmp_path):
    rows = [(0, 1, [1.0, 0.0]), (3600, 1, [1.0, 0.0]), (7201, 1, [1.0, 0.0])]  # 3,600 and 3,601 apart
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["c17_near_repeats_hour"](spark, str(tmp_path)).collect()] == [(3600, 0, 1.0)]


def test_activation_by_words_of_labels(spark, tmp_path):
    """The seed is the node whose label the query names, and the core is always active; more than 45 documents are nodes."""
    docs = [(i, f"text {i}", "en", "hostels" if i == 0 else "src1", 7) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(20)) + " (hostels)")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES["k8_graph_nodes_whole"](spark, str(tmp_path)).where("type = 'document'").count() == 60
    got = {r.id: r.activation for r in QUERIES["k9_activation"](spark, str(tmp_path)).collect()}
    assert got["core"] >= 0.65 and got["dept-hostels"] >= 0.35


EDGES = [(0, "älos und"), (1, "x theé"), (2, "leſ"), (3, "leſx"), (4, "licenſed ä"), (5, "éABCDEF"), (6, "ABCDEFé 123"), (7, "clos"), (8, None), (9, "_the"), (10, "LOS.")]


def edge_words(spark, path):
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in EDGES], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_concepts_at_word_edges_of_sql(spark, tmp_path):
    path = edge_words(spark, tmp_path)
    assert same(QUERIES["d14_concepts"](spark, path), connect(path), ORACLE["d14_concepts"]) is None


@pytest.mark.parametrize("name", ["k8_graph_edges", "k8_graph_edges_whole", "k8_graph_nodes"])
def test_graph_at_word_edges_of_sql(spark, tmp_path, name):
    path = edge_words(spark, tmp_path)
    assert same(QUERIES[name](spark, path), connect(path), ORACLE[name]) is None
