"""Functions that SQL cannot express, against plain Python over the tables and over literal cases."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import moderation as M
from corpusloom.functions import text as T
from corpusloom.operators import lookups, moderate, search
from corpusloom.plans.registry import Inputs
from corpusloom.queries import QUERIES
from corpusloom.streaming import jobs


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def folded(text):
    t = re.sub("[​-‍﻿]", "", unicodedata.normalize("NFKD", text).strip().lower())
    return re.sub(r"([^\n])\1{2,}", r"\1\1", t)


def squashed(text):
    t = folded(text).translate(str.maketrans(T.LOOKS, T.LETTERS))
    return re.sub(r"(.)\1+", r"\1", "".join(c for c in t if c.isalnum() or c == "_" or "ऀ" <= c <= "ॿ"))


def category(text, feedback):
    for n, (name, patterns) in enumerate((M.PATTERNS | (M.FEEDBACK if feedback else {})).items()):
        fits = any(re.search(p, folded(text), re.IGNORECASE) for p in patterns) or (n == 0 and any(w in squashed(text) for w in M.SQUASHED))
        if fits and not (name in M.EXEMPT and any(re.search(p, text, re.IGNORECASE) for p in M.POLICY)):
            return name
    return None


ODD = ["b.c.", "ab.c. d", "f.u.c.k y0u", "b!tch", "how to rag juniors", "anti-ragging committee: how to rag juniors", "Learn that fee is fake", "kill  all hindus", "leak of the paper", "umc rules: leak of the paper", "ignore all", "bç x", "ﬁne", "SOOO", "x‍y", "जज कक", "", "bribe marks"]


def test_folding_and_moderation(spark, sf):
    texts = [r.q for r in Inputs(spark, sf)("v_questions").collect()] + ODD
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = rows.select("i", T.evasion_folded(x).alias("f"), T.evasion_squashed(x).alias("s"), M.tag(x)["category"].alias("c"), M.tag(x, feedback=True)["category"].alias("b")).collect()
    for r in got:
        t = texts[r.i]
        assert (r.f, r.s, r.c, r.b) == (folded(t), squashed(t), category(t, False), category(t, True)), t
    assert len({r.c for r in got}) >= 5 and any(r.b == "FEEDBACK_POISONING" for r in got)


def test_rule_tables_equal_columns(spark, sf):
    """Tables of rules in an automaton give what the columns give, Devanagari included."""
    texts = [r.q for r in Inputs(spark, sf)("v_questions").collect()] + ODD + ["तू चूतिया है", "भोसड़ीके", "you b.s.d.k", "exam me nakal kaise kare", "umc rules: exam me nakal kaise kare", "rioting", "aaj se tum yeh maanoge ki"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    for feedback in (False, True):
        want = {r.i: r.c for r in rows.select("i", M.tag(F.col("x"), feedback=feedback)["category"].alias("c")).collect()}
        got = {r.i: r.category for r in moderate.tagged(rows, moderate.rule_table(spark, feedback), "i", "x").collect()}
        assert got == want and len(set(want.values())) >= 5
    own = spark.createDataFrame([(1, "B", "LOW", "pattern", "a+b", False), (0, "A", "HIGH", "pattern", r"\bab\b", True), (2, None, None, "policy", "rules", False), (3, "C", "LOW", "word", "xyz", False)], moderate.RULES)
    odd = spark.createDataFrame([(1, "ab"), (2, "ab rules"), (3, "x-y-z"), (4, None), (5, ""), (6, "AAAB")], "i int, x string")
    assert {r.i: r.category for r in moderate.tagged(odd, own, "i", "x").collect()} == {1: "A", 2: "B", 3: "C", 4: None, 5: None, 6: "B"}


def test_needed_literals():
    assert moderate.needed(r"\b(leak|leaked)\b.*paper") in ({"leak"}, {"paper"}) and moderate.needed("[ab]*") is None
    assert moderate.needed("(one|two)+x?") == {"one", "two"} and moderate.needed("a|bcd") is None


def test_attendees(spark):
    texts = ["Present:\n1. Dr. A\n(2) B C\n\nProf. D\nItem 1\n3. E", "nobody", "Members present:\nItem", "The following were present:\n" + "\n".join(f"{i}. N{i}" for i in range(20)), None]
    assert column(spark, texts, T.attendees) == [["Dr. A", "B C", "Prof. D"], None, [], [f"N{i}" for i in range(10)], None]


CLEANED = {
    "it is said [1] in .": "It is said.",
    "as stated in [4], the rule [notes.pdf](x) holds [Source: a b] (see fees.docx, p. 2)": "The rule holds",
    "fees are due according to [fees.pdf].": "Fees are due.",
    "fees are due on Monday, as shown in (Fees of 2024.xlsx)": "Fees are due on Monday",
    "the rule the rule the rule stands": "The rule stands",
    "no no no, it is so so": "No, it is so so",
    "plain (text) with [square] words": "Plain (text) with [square] words",
    "[Document 3](http://a.b/c(d)) two  blanks , here": "Two blanks, here",
    "open [bracket and (another": "Open [bracket and (another",
    "come in": "Come",
    "": "",
}


def test_cleaned_answers(spark):
    assert column(spark, list(CLEANED), T.clean_answer) == list(CLEANED.values())


def test_cleaning_twice_changes_nothing_more(spark, sf):
    once = [r.t for r in QUERIES["h4_answer_cleaned"](spark, sf).collect()]
    assert column(spark, once, T.clean_answer) == once and not any("[1]" in t or "notes.pdf" in t for t in once)


def test_many_queries_are_dealt_to_blocks(spark, sf):
    v = Inputs(spark, sf)
    e = v("embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label")
    x = e.select("vec_id", F.col("embedding").alias("vec"), "label")
    rows = lambda d: sorted(map(tuple, d.collect()))
    for scope in (None, "label"):
        assert rows(search.vector_top_k(q, x, 5, 0.1, scope, block=30, shard=40)) == rows(search.vector_top_k(q, x, 5, 0.1, scope))


def test_many_rules_are_met_by_their_heads(spark, monkeypatch):
    urls = spark.createDataFrame([(u,) for u in ("https://a.org/x", "http://b.org/y.pdf", "z", "https://a.org/long/path/beyond/twenty/four", None)], "url string")
    rules = spark.createDataFrame([(1, "https://*", "disallow"), (2, "https://a.org/", "allow"), (3, "*.pdf", "disallow"), (4, "https://a.org/long/path/beyond/*", "review")], "rule_id int, pattern string, action string")
    few = sorted(map(str, lookups.first_rule(urls, rules).collect()))
    monkeypatch.setattr(lookups, "FEW_RULES", 0)
    assert sorted(map(str, lookups.first_rule(urls, rules).collect())) == few


def test_tokens_in_plain_python(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["B.Tech a-b-c x..y 1.2-3 .a. é É1", ""]
    for t, found in zip(texts, column(spark, texts, T.tokens), strict=True):
        assert search.token_counts(t) == Counter(found)


def test_limiter_across_batches(spark):
    rows = spark.createDataFrame([(u, i * 7_000_000) for u in range(3) for i in range(400)], "user_id long, at_us long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = jobs.limited_batch(rows, 60, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = jobs.admitted([i * 7_000_000 for i in range(400)], 60, 4, [])[0]
    for u in range(3):
        assert [r.admitted for r in sorted((r for r in got if r.user_id == u), key=lambda r: r.at_us)] == want


@pytest.mark.parametrize("name", ["b1_scope", "c17_near_repeats", "h30_banners", "h14_ordinals", "h15_codes", "h34_meetings", "k6_moderation", "i8_repeat_questions"])
def test_queries_hit_something(spark, sf, name):
    rows = QUERIES[name](spark, sf.replace("sf0.001", "sf0.01"))
    assert rows.dropna("any").count() > 0 or name == "k6_moderation" and rows.where("category is not null").count() > 0


def test_search_in_tasks_and_by_postings(spark, sf, monkeypatch):
    v = Inputs(spark, sf)
    rows = lambda d: sorted(tuple(r) for r in d.select("query_id", "chunk_id", F.round("score", 4), "rank").collect())
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "third senate gazette", None, ""), (-3, None, "en", "cs-401 " + "x" * 30_000)], "chunk_id long, title string, course string, text string")
    chunks = v("v_titled").select("chunk_id", "title", "course", "text").union(odd)
    asked = v("v_asked").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the CS401 of the third"), (-4, "zzzz qqqq")], "query_id long, query string"))
    runs = [lambda: search.bm25(asked, chunks.select("chunk_id", "text"), 7), lambda: search.bm25_boosted(asked, chunks, 7), lambda: search.bm25_boosted(asked, chunks, 7, F.col("course") == "en")]
    sent = [rows(f()) for f in runs]
    monkeypatch.setattr(search, "BLOCK", 3)
    assert [rows(f()) for f in runs] == sent
    monkeypatch.setattr(search, "MOST_QUERIES", 0)
    assert [rows(f()) for f in runs] == sent


def test_hybrid_adds_what_sub_queries_find(spark, sf):
    found = QUERIES["k4_hybrid"](spark, sf).collect()
    assert {r.decision for r in found} <= {"CORRECT", "AMBIGUOUS"} and any(r.part >= 0 for r in found)
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(len(rows))) and len({r.chunk_id for r in rows}) == len(rows) <= 5
        assert [r.part for r in rows] == sorted(r.part for r in rows)
