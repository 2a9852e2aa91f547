"""Line dedup from seeds: against all runs in plain Python, ties, one document in very many rows, and what fingerprints decide."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, pii

from . import plain

SHAPE = "doc_id long, text string"


def cut(spark, docs, least):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, SHAPE), least).collect()}


def expected(docs, least):
    """Texts of the documents of which a word is left, or that lose nothing."""
    return {d: t for d, _, t in plain.without_repeats([(d, None, t) for d, t in docs], least)}


@pytest.mark.parametrize("seed", range(4))
def test_random_lines_against_all_runs(spark, seed):
    """Few different lines of one to six words, so that runs meet, nest, tie for their first place and overlap themselves."""
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))) for _ in range(3 + 3 * seed)] + ["", " "]
    docs = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 60)))) for d in range(25)]
    want, got = expected(docs, 9), cut(spark, docs, 9)
    assert {d: t for d, t in got.items() if d in want} == want and not any(t.split() for d, t in got.items() if d not in want)
    assert any(t != dict(docs)[d] for d, t in got.items())


def test_a_run_that_repeats_itself(spark):
    docs = [(1, "\n".join(["a b c d e"] * 40)), (2, "\n".join(["x y"] + ["a b c d e"] * 3 + ["z"]))]
    got = cut(spark, docs, 10)
    assert got == {1: "a b c d e\na b c d e", 2: "x y\nz"}


def test_ties_of_the_first_place(spark):
    run = "one two three\nfour five six\nseven eight nine"
    got = cut(spark, [(None, run), (None, run + "\nten"), (1, "a\n" + run + "\nb\n" + run), (1, run)], 9)
    assert got[1] in ("a\nb", "")  # both documents of id 1 come after the one without id


def test_matches_are_extended_beyond_the_seed(spark):
    """The fingerprint is one line; what goes is the whole run around it, and nothing that differs."""
    same = [f"line {i} of the shared passage" for i in range(30)]
    docs = [(1, "\n".join(["first head"] + same + ["first tail"])), (2, "\n".join(["second head"] + same + ["second tail"])), (3, "\n".join(["third"] + same[10:20]))]
    got = cut(spark, docs, 12)
    assert got[1] == docs[0][1] and got[2] == "second head\nsecond tail" and got[3] == "third"


def test_without_fingerprints_nothing_is_found(spark, monkeypatch):
    run = "one two three\nfour five six\nseven eight nine"
    plan = line_dedup.windows
    monkeypatch.setattr(line_dedup, "windows", lambda lines, least: plan(lines, least).withColumn("fp", F.xxhash64("_r1", "_r2", "start")))
    assert cut(spark, [(1, run), (2, run)], 9) == {1: run, 2: run}


@pytest.mark.parametrize("of", ["lines", "personal data"])
def test_one_document_in_a_hundred_thousand_rows(spark, of):
    """A text without id in very many rows is one document's work: its lines and candidates are taken once."""
    text = "mail a.b@c.de now\nand some words more of it"
    many = spark.range(100_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = many.union(spark.createDataFrame([(1, text), (2, "other words")], SHAPE))
    if of == "lines":
        lines = line_dedup.windows(line_dedup._lines(line_dedup.one_row_each(docs)), 5)
        assert lines.count() == 4
        got = line_dedup.dedup_lines(docs, 5).groupBy("doc_id", "text").count().collect()
        assert sorted((r["doc_id"] or 0, r["text"], r["count"]) for r in got) == [(0, text, 100_000), (1, "", 1), (2, "other words", 1)]
    else:
        assert pii.candidates(docs).count() == 2
        got = pii.report(docs).groupBy("doc_id", F.size("base_spans").alias("n")).count().collect()
        assert sorted((r["doc_id"] or 0, r["n"], r["count"]) for r in got) == [(0, 1, 100_000), (1, 1, 1), (2, 0, 1)]
