"""The defined cases of every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, other columns."""

import pytest

from corpusloom.llm import decontam, line_dedup, mixing, near_join, pii, quality_gam, quality_rules, toxicity, url_rules, warc

#: Columns named like those that operators make for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, items string, spans string, rank int, target string, host string, k_id int, th int, one int, words string, p_copies int, runs string, k1 int, _r1 int, _size int, range int, copy_no string"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [(1, None), (None, "some words of a text without an id stand here for now"), (2, ""), (3, " \t\n "), (4, LONG), (5, "same text " * 10), (5, "same text " * 10), (6, "x" * 200_000), (7, "mail a.b@c.de and +1 (543) 555-9258 ."), (None, None), (8, "1.2.3.4 " + "9" * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 7 else "a", 1, 5, "i", "s", 1, "t", "h", 2, 2, 2, "w", 2, "r", 2, 2, 2, 2, "c") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def bench(spark, rows=((1, "words of a text without an id"), (None, None), (2, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def runs(spark, labels):
    return {
        "rules": lambda d: quality_rules.judge(d, quality_rules.fit(d, labels)),
        "keep_good": lambda d: quality_rules.keep_good(d, None),
        "mix": mixing.mix,
        "take_mix": mixing.take_mix,
        "lines": line_dedup.dedup_lines,
        "gam": lambda d: quality_gam.classify(d, quality_gam.fit(d, labels)),
        "near": near_join.near_join,
        "keep_one": near_join.keep_one_each,
        "bench": lambda d: decontam.report(d, bench(spark)),
        "decontaminate": lambda d: decontam.decontaminate(d, bench(spark)),
        "pii": pii.report,
        "toxic": lambda d: toxicity.classify(d, toxicity.fit(d, labels)),
    }


NAMES = ("rules", "keep_good", "mix", "take_mix", "lines", "gam", "near", "keep_one", "bench", "decontaminate", "pii", "toxic")
ONE_EACH = {"rules", "mix", "lines", "gam", "near", "bench", "decontaminate", "pii", "toxic"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, no_labels, name):
    got = runs(spark, no_labels)[name](docs).collect()
    if name in ONE_EACH:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    if name in ("lines", "decontaminate"):
        assert {c: getattr(got[0], c) for c in ("lang", "items", "spans", "host")} == {"lang": "en", "items": "i", "spans": "s", "host": "h"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, no_labels, name):
    assert runs(spark, no_labels)[name](none).collect() == []


def test_repeated_rows_are_judged_alike(spark, docs, no_labels):
    for name in ("lines", "near", "bench", "pii", "rules"):
        twice = [r for r in runs(spark, no_labels)[name](docs).collect() if r.doc_id == 5]
        assert len(twice) == 2 and (name == "near" or twice[0] == twice[1])


def test_near_copies_keep_one_row_of_repeated_ones(docs):
    kept = [r.doc_id for r in near_join.keep_one_each(docs).collect()]
    assert kept.count(5) == 1 and sorted(x for x in kept if x) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_columns_of_other_names_are_given_back(docs):
    for f in (mixing.take_mix, line_dedup.dedup_lines, near_join.keep_one_each, lambda d: quality_rules.keep_good(d, None)):
        for r in f(docs).collect():
            assert (r.k_id, r.th, r.one, r.words, r.p_copies, r.runs, r.k1, r["_r1"], r["_size"], r["range"], r.lang) == (2, 2, 2, "w", 2, "r", 2, 2, 2, 2, "en")


def test_take_mix_replaces_copy_no(docs, tmp_path):
    mixing.take_mix(docs).write.parquet(str(tmp_path / "mix"))
    assert {r.copy_no for r in mixing.take_mix(docs).collect()} <= {1, 2}


def test_ties_of_many_small_sources(spark):
    """One document a source, of few sizes: whole ranges of equal finish times."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 2)), f"s{i:05d}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) <= 1.5 * total and sum(r.taken for r in got) >= 1.5 * total - 4
    assert all(r.taken <= 2 * r.size for r in got)
    order = sorted((p * r.size / r.target, r.source, p, r.doc_id) for r in got for p in (1, 2) if r.target)
    cut = sum(r.copies for r in got)
    want = {}
    for f, s, p, d in order[:cut]:
        want[d] = want.get(d, 0) + 1
    assert {r.doc_id: r.copies for r in got if r.copies} == want


def test_pages_with_long_urls_and_texts(spark, no_labels):
    rows = [(1, "http://a.b/" + "/".join(f"part{i}" for i in range(3000)) + "?" + "&".join(f"k{i}=1" for i in range(500)), "z" * 3_000_000), (2, "http://" + "h" * 5000 + ".org/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: (len(r.path), r.verdict) for r in url_rules.judge(pages, no_labels).collect()} == {1: (len(rows[0][1].split("?")[0]) - 10, "allow"), 2: (2, "allow")}
    index, folder = warc.archive_pages(pages)
    assert {r.page_id: r.payload_bytes for r in warc.read_records(index, folder).collect()} == {1: 3_000_000, 2: 0}


def test_pages(spark, no_labels):
    rows = [(1, "http://A.Example.NET/en/x?q#f", "p" * 200), (2, None, "p" * 200), (2, None, "p" * 200), (None, "no host", None), (3, "https://b.net", "short"), (4, "x://b.net/1", "short"), (5, "h://org/fr/\r\nX: y", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, no_labels).collect()}
    assert (1, "a.example.net", "/en/x", "example.net/en/", "allow") in got
    assert (None, "", "", None, "allow") in got and (3, "b.net", "", None, "allow") in got and (4, "b.net", "/1", "net/", "block") in got
    index, folder = warc.archive_pages(pages)
    back = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect()), key=str)
    assert back == sorted([(1, 200, "response", None), (2, 200, "revisit", 1), (2, 200, "revisit", 1), (0, 0, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 120, "response", None)], key=str)
    empty = pages.limit(0)
    index, folder = warc.archive_pages(empty)
    assert warc.read_records(index, folder).count() == 0 and url_rules.judge(empty, no_labels).count() == 0


def test_tied_least_page(spark):
    pages = spark.createDataFrame([(1, "a", "p" * 200), (1, "a", "p" * 200), (2, "b", "p" * 200)], "page_id long, url string, html string")
    index, folder = warc.archive_pages(pages)
    assert sorted((r.page_id, r.record_type) for r in warc.read_records(index, folder).collect()) == [(1, "response"), (1, "revisit"), (2, "revisit")]
