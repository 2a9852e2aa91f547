"""Spelling variants, whitening and language identification against plain Python, and their defined cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.llm import language_id, queries, variants, whitening
from corpusloom.llm.common import materialise

DOCS = "doc_id long, text string, WORD string, n string, key int"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


TEXTS = [
    (1, "receive " * 150 + "recieve receeive receive, RECEIVE; recevie " * 2 + "recieves recieves"),
    (2, "receives receives Éclairer éclairer éclairer éclairerx éclairerx straße-straßen straßen"),
    (None, "receive " * 3 + "abcdefg abcdefg " * 8 + "abcdefh abcdefh abcdefi abcdefi bcdefg"),
    (3, None),
    (4, ""),
    (4, "###!!! 12345 _"),
    (5, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + "y " + "x" * 29_999 + "y"),
    (6, "abcdefg " * 100 + "abcdeffg abcdeffg bbcdefg bbcdefg"),
    (6, "abcdefg " * 100 + "abcdeffg abcdeffg bbcdefg bbcdefg"),
    (7, "tieaaaa tieaaaa tieaaab " + "tieaaac " * 20 + "tieaaad " * 20 + "tieaaab"),
]


@pytest.mark.parametrize("settings", [{}, {"symbols": 2, "crowded": 1}, {"symbols": 3, "crowded": 4}, {"symbols": 16}])
def test_variants_against_all_pairs(spark, settings):
    docs = spark.createDataFrame([(i, t, "w", "n", 1) for i, t in TEXTS], DOCS)
    rows = got(variants.variants(docs, **settings))
    assert len(rows) == len(set(rows)) and set(rows) == plain_variants(TEXTS)


def test_variants_chain_of_forms(spark):
    words = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000)], "word string, n long")
    rows = {r["word"]: r["root"] for r in variants.group_variants(materialise(words, "words")).collect()}
    assert set(rows.values()) == {"aaabbbb"}


def test_variants_of_nothing(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (None, "a b")], "doc_id long, text string")).count() == 0


def test_variants_equal_sql(spark, sf):
    from tests.oracle import connect, same

    assert same(queries.QUERIES["op11_spelling_variants"](spark, sf), connect(sf), queries.ORACLE["op11_spelling_variants"]) is None


def test_every_one_edit_neighbour_has_a_key():
    words = ["receive", "éclairer", "aaaaaaa"]
    at, keys = variants._keys(words, 8, "dri")
    held = {i: set(keys[at == i].tolist()) for i in range(len(words))}
    for i, w in enumerate(words):
        others = [w] + [w[:j] + w[j + 1 :] for j in range(len(w))] + [w[:j] + c + w[j + k :] for j in range(len(w) + 1) for c in "aqzéÿ" for k in (0, 1)]
        _, theirs = variants._keys(list(dict.fromkeys(others)), 8, "")
        assert set(theirs.tolist()) <= held[i]
        assert len(held[i]) == (at == i).sum()


def plain_whitening(vectors, keep=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    far = n * x - s
    c = far.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    e = e[e > 1e-12 * e.sum()]
    return far, c @ u[:, : min(keep, len(e))] / np.sqrt(e[:keep]), e[:keep] / np.trace(c.T @ c / n)


def test_whitening_against_eigh(spark, sf):
    found = queries.QUERIES["op12_whitening"](spark, sf).toPandas()
    given = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    far, white, explained = plain_whitening(given["embedding"])
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    assert found["n"].eq(len(given)).all() and len(found) == 8 * len(given)
    assert np.abs(wide * np.sign((wide * white).sum(0)) - white).max() < 1e-8
    one = found[found["component"] == 1].set_index("vec_id")["deviation"].loc[given["vec_id"]]
    assert one.tolist() == [int((r * r).sum()) for r in far]
    assert np.abs(found.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-9
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-10


SHAPE = "vec_id long, embedding array<float>, component string, N int"


def test_whitening_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=3)], "c", 1) for i in range(40)]
    bad = [(90, None, "c", 1), (91, [1.0, None, 2.0], "c", 1), (92, [1.0, float("nan"), 0.0], "c", 1), (93, [float("inf"), 1.0, 1.0], "c", 1), (94, [], "c", 1), (95, [1.0, 2.0], None, None)]
    found = whitening.whiten(spark.createDataFrame([*good, good[0], (None, good[1][1], "c", 1), *bad], SHAPE)).toPandas()
    assert sorted(found["vec_id"].fillna(-1).unique()) == [-1, *range(40)] and set(found["component"]) == {1, 2, 3}
    assert (found["vec_id"] == 0).sum() == 6 and found["n"].eq(42).all()
    _, white, _ = plain_whitening([np.float32(g[1]) for g in [*good, good[0], good[1]]])
    assert np.abs(np.abs(found[found["vec_id"] == 7].sort_values("component")["whitened"]) - np.abs(white[7])).max() < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], SHAPE)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], "c", 1), (2, [0.5, 0.5], "c", 1)], SHAPE)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [i / 7, 2 * i / 7], "c", 1) for i in range(8)], SHAPE)).toPandas()
    assert 1 in set(line["component"]) and line[line["component"] == 1]["whitened"].std(ddof=0) == pytest.approx(1.0, abs=1e-6)


def test_whitening_of_large_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) * [1e-2, 1, 1e3, 1e4]], "c", 1) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, SHAPE)).toPandas()
    far, white, explained = plain_whitening([np.float32(r[1]) for r in rows])
    assert found[found["component"] == 1]["deviation"].tolist() == [int((r * r).sum()) for r in far]
    assert np.abs(found.groupby("component")["explained"].first().to_numpy() / explained - 1)[:2].max() < 1e-6


def test_jacobi_on_the_triangular_factor():
    rng = np.random.default_rng(7)
    for d in (1, 2, 5, 16):
        a = rng.normal(size=(40, d)) * np.logspace(0, -5, d)
        values, vectors = whitening.components(a.T @ a)
        assert np.abs(values / np.linalg.svd(a, compute_uv=False) ** 2 - 1).max() < 1e-6
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        low, p = whitening.pivoted_cholesky(a.T @ a)
        assert np.abs(low @ low.T - (a.T @ a)[np.ix_(p, p)]).max() < 1e-12 and np.abs(np.triu(low, 1)).max(initial=0) == 0


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.QUERIES["op13_language_id"](spark, sf).join(docs, "doc_id").toPandas()
    assert found["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]
    held = found[found["held_out"]]
    assert len(found) == docs.count() and (held["lang"] == held["lang_pred"]).mean() >= 0.93
    assert found["score"].between(0, 1).all()


def test_languages_of_odd_rows(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and thinks of nothing ", "le renard brun saute par dessus le chien qui pense toujours "
    rows = [(i, en * (i + 3) if i % 2 else fr * (i + 3), "en" if i % 2 else "fr", "x", 1.0) for i in range(60)]
    odd = [(100, None, "en", "x", 1.0), (101, "", None, "x", 1.0), (102, "123 ... — _", "fr", "x", 1.0), (None, en, "en", "x", 1.0), (103, fr * 20_000, None, "x", 1.0), (104, fr, None, None, None), (104, fr, None, None, None), (105, "हिन्दी", None, "x", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string, score double")
    found = language_id.languages(docs).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + len(odd)
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and {by[i]["score"] for i in (100, 101, 102)} == {0.0}
    assert by[103]["lang_pred"] == by[104]["lang_pred"] == "fr" and by[None]["lang_pred"] == "en"
    assert by[105]["lang_pred"] in ("en", "fr") and by[105]["rejected"]  # a tie: both dictionaries say nothing of it
    assert len({tuple(r) for r in found if r["doc_id"] == 104}) == 1
    empty = language_id.languages(docs.where("false"))
    assert empty.count() == 0
    unknown = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert unknown == [Row(lang_pred="und", score=0.0)]
