"""Activation of graph nodes by queries: labels against queries in tasks, edges of the seeds alone."""

from corpusloom.operators import graph, search
from corpusloom.plans.joins import CONCEPTS
from corpusloom.queries import ORACLE, QUERIES

from .oracle import connect, same


def graph_input(spark, path, texts, asked):
    """documents with these texts, and questions."""
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def shuffled(spark) -> dict[int, int]:
    """Rows that each stage so far has shuffled."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {x.stageId(): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}


def test_activation_shuffles_no_pairs(spark, tmp_path):
    """All labels share a word with all queries; what is shuffled grows with their sum, not with their product."""
    path = graph_input(spark, tmp_path, [f"common word {i * 7919} of some text" for i in range(600)], [f"a common question {i}" for i in range(80)])
    before = shuffled(spark)
    got = QUERIES["k9_activation"](spark, path)
    assert got.select("query_id").distinct().count() == 80
    assert sum(n for i, n in shuffled(spark).items() if i not in before) < 600 * 80 / 3


def test_activation_rounds_as_sql(spark, tmp_path):
    """0.365 + 0.1 is 46.5 hundredths, though a little less than 0.465."""
    path = graph_input(spark, tmp_path, ["green south river green north stone"], ["south of of blue of an of"])
    got = {r.id: r.activation for r in QUERIES["k9_activation"](spark, path).collect()}
    assert got["doc-0"] == 0.47
    assert same(QUERIES["k9_activation"](spark, path), connect(path), ORACLE["k9_activation"]) is None


def test_activation_by_words_of_sql(spark, tmp_path):
    """Blanks and lower case are those of the SQL; a word stands in a query as part of another, or not at all."""
    texts = ["no\u00a0break here", "ver\u000btical\ttab", "ΟΔΟΣ ΣΑΣ ver", "İstanbul x", "", "   ", "abcd", "x" * 300, "wxyz wxyz wxyz", "\U0001d49c\U0001d49c\U0001d49c\U0001d49c"]
    asked = ["no\u00a0break", "ver\u000btical", "οδοσ σασ", "istanbul", "xabcdx", "ab cd", "", " ", "WXYZ", "doc_3", "\U0001d49c\U0001d49c\U0001d49c\U0001d49c!", "x" * 40]
    path = graph_input(spark, tmp_path, texts, [t for t in asked if t.strip()])
    assert same(QUERIES["k9_activation"](spark, path), connect(path), ORACLE["k9_activation"]) is None


def test_labels_dealt_equal_labels_sent(spark):
    words = ["river", "stone", "of", "cloudy", "an", "north"]
    queries = spark.createDataFrame([(i, " ".join(words[(i * k) % 6] for k in range(1, 6))) for i in range(30)] + [(30, None), (None, "river")], "query_id long, text string")
    labels = spark.createDataFrame([(f"n{i}", " ".join(words[(i + k * k) % 6] for k in range(i % 5))) for i in range(90)] + [("null", None), (None, "river")], "id string, label string")
    some = lambda **by: sorted(map(tuple, search.label_top_k(queries, labels, 4, **by).collect()))
    got = some()
    assert len(got) == 31 * 4 and got == some(block=7, shard=20) == some(block=30, shard=1000)


def test_edges_at_some_nodes(spark, tmp_path):
    path = graph_input(spark, tmp_path, ["the 123", "los CAPITALS", None, "x 4567 @", "licensed"], ["q"])
    d = spark.sql("SELECT doc_id AS document_id, text, source AS department, lang AS course, text AS title FROM {d}", d=spark.read.parquet(f"{path}/documents.parquet"))
    every = graph.graph_edges(d, graph.graph_nodes(d, concepts=CONCEPTS), CONCEPTS)
    at = ["core", "doc-3", "concept-numbers", "absent"]
    got = graph.graph_edges(d, graph.graph_nodes(d, concepts=CONCEPTS), CONCEPTS, spark.createDataFrame([(x,) for x in at], "id string"))
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in every.collect() if r.src in at or r.dst in at) != []
