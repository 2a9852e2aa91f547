"""Scores at a threshold, and rules of equal confidence."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality_gam, toxicity, url_rules


@pytest.mark.parametrize("score", [0.7, np.nextafter(0.7, 0)])
def test_toxic_at_the_threshold(spark, score):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = toxicity.classify(docs, SimpleNamespace(score=lambda text, s=float(score): s)).collect()
    assert {r["predicted"] for r in got} == {int(score >= 0.7)}


@pytest.mark.parametrize("score", [0.3, np.nextafter(0.3, 0)])
def test_good_at_the_threshold(spark, score):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = quality_gam.classify(docs, SimpleNamespace(score=lambda rows, s=float(score): np.full(len(rows), s))).collect()
    assert {r["predicted"] for r in got} == {int(score >= 0.3)}


def test_rules_of_equal_confidence(spark):
    rules = spark.createDataFrame([(1, ["a"], 0.9, 0.5), (2, ["b"], 0.9, 0.4), (3, ["a", "c"], 0.8, 0.4)], "rule_id long, antecedent array<string>, confidence double, support double")
    sets = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["a", "c"]), ("z", ["c"])], "key string, tokens array<string>")
    got = {r["key"]: r["t"] for r in url_rules.fitting(sets, rules).select("key", F.array_join("mined.antecedent", " ").alias("t")).collect()}
    assert got == {"x": "b", "y": "a"}
    equal = spark.createDataFrame([(["a"], 0.9, 0.5), (["a", "b"], 0.9, 0.3), (["a", "c"], 0.95, 0.3)], "antecedent array<string>, confidence double, support double")
    assert sorted(r["antecedent"] for r in url_rules.shortest(equal).collect()) == [["a"], ["a", "c"]]
