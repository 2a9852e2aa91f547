"""Queries over scans, filters and set operations (A, B, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import changes, feeds, reports
from corpusloom.sources.scratch import new_path
from corpusloom.sources.snapshots import SnapshotTable

from .registry import query

DOMAINS = ["example.org", "blog.example.com"]
_HOST = r"lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', ''))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)"


_SCAN = "SELECT document_id, title, coalesce(text, '') AS text, department FROM v_documents"


@query("a1_scan_whole", _SCAN)
@query("a1_scan", _SCAN)
def a1(v):
    """All rows and whole texts; the caps of the inventory are limits of memory and default off."""
    return v("v_documents").select("document_id", "title", F.coalesce("text", F.lit("")).alias("text"), "department")


def _text_files(v):
    """The documents as text files below a folder for each department, written by Spark."""
    from corpusloom.sources.scratch import new_path

    folder = new_path(v.spark)
    v("v_documents").select("department", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("department").text(f"{folder}/lib")
    return folder


@query("a2_file_scan", "SELECT department, sum(strlen(text) + 1)::BIGINT AS bytes FROM v_documents GROUP BY 1")
def a2(v):
    """Bytes of the text files found below a folder, by department."""
    from corpusloom.sources.pages import scan_files

    f = scan_files(v.spark, _text_files(v)).select(F.regexp_extract("path", "department=([^/]*)/", 1).alias("department"), "length")
    return f.groupBy("department").agg(F.sum("length").alias("bytes"))


@query("a3_text_pages", r"SELECT department, sum(length(regexp_replace(text, '\s', '', 'g')))::BIGINT AS n_chars FROM v_documents GROUP BY 1")
def a3(v):
    """Characters but blanks of the pages that text files give, by department."""
    from corpusloom.sources.pages import scan_files, text_pages

    p = text_pages(scan_files(v.spark, _text_files(v)))
    return p.groupBy(F.regexp_extract("path", "department=([^/]*)/", 1).alias("department")).agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n_chars"))


@query("a6_json_set", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def a6(v):
    """Conversations written as lines of JSON and read back as a set of cases."""
    from corpusloom.sources.pages import json_set
    from corpusloom.sources.scratch import new_path

    folder = new_path(v.spark)
    v("conversations").write.json(folder)
    return json_set(v.spark, folder, "conv_id long, turn int, role string, text string").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("a4_html_source", "SELECT page_id, html, length(html) AS n_chars FROM pages WHERE html IS NOT NULL AND strlen(html) <= 5000000 AND html NOT LIKE '%PDF-%' AND html NOT LIKE 'PK%' AND html NOT LIKE 'Rar!%' AND html NOT LIKE 'MZ%'")
def a4(v):
    from corpusloom.sources.pages import html_pages

    return html_pages(v("pages").select("page_id", F.col("html").cast("binary").alias("body"))).select("page_id", F.col("text").alias("html"), F.length("text").cast("long").alias("n_chars"))


@query("a5_json_column", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def a5(v):
    return v("events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("a7_upsert", """WITH o AS (SELECT vec_id AS id, label, 1 AS v FROM embeddings WHERE vec_id % 3 <> 0), n AS (SELECT vec_id AS id, label + 100 AS label, 2 AS v FROM embeddings WHERE vec_id % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.label, o.label) AS label, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.id = n.id""")
def a7(v):
    """Points written to a snapshot table and then written anew in part; the second write comes twice, as a repeated batch."""
    e, points = v("embeddings"), SnapshotTable(v.spark, new_path(v.spark, "loom-points"), "id", "id long, label int, v int", 16)
    points.upsert(e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), "label", F.lit(1).alias("v")), "v", ("points", 0))
    for _ in range(2):
        points.upsert(e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 100).alias("label"), F.lit(2).alias("v")), "v", ("points", 1))
    return points.read()


@query("a8_unindexed", "SELECT document_id FROM v_documents WHERE document_id NOT IN (SELECT vec_id FROM embeddings)")
def a8(v):
    return changes.unindexed(v("v_documents").select("document_id"), v("embeddings").select(F.col("vec_id").alias("document_id")), "document_id")


@query("a9_copy_totals", "SELECT 'documents' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS same FROM documents UNION ALL SELECT 'pages', count(*), count(*), true FROM pages")
def a9(v):
    from corpusloom.sources.scratch import materialise

    tables = {n: v(n) for n in ("documents", "pages")}
    return changes.parity(tables, {n: materialise(d) for n, d in tables.items()}).drop("all_same")


@query("a10_markdown_table", r"""WITH r AS (SELECT session_id, list(replace(sender, '|', '\|') || ' | ' || turn || ' | ' || length(content) ORDER BY turn) AS ls FROM v_messages GROUP BY session_id)
SELECT session_id, '| sender | turn | chars |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(ls, lambda x: '| ' || x || ' |'), chr(10)) AS md FROM r""")
def a10(v):
    cells = F.transform(F.array_sort(F.collect_list(F.struct("turn", "sender", F.length("content").alias("n")))), lambda r: F.array(r["sender"], r["turn"].cast("string"), r["n"].cast("string")))
    head = F.array(F.array(F.lit("sender"), F.lit("turn"), F.lit("chars")))
    return v("v_messages").groupBy("session_id").agg(cells.alias("rows")).select("session_id", T.markdown_table(F.concat(head, "rows")).alias("md"))


@query("b1_scope", "SELECT document_id, department, course, semester FROM v_documents WHERE department = 'src3' AND semester = 'Semester4'")
def b1(v):
    return feeds.in_scope(v("v_documents"), department="src3", course="all", semester="Semester4").select("document_id", "department", "course", "semester")


@query("b2_search", "SELECT document_id FROM v_documents WHERE title ILIKE '%the%' OR department ILIKE '%the%'")
def b2(v):
    return v("v_documents").where(feeds.contains_any(["title", "department"], "the")).select("document_id")


@query("b3_flags", "SELECT message_id, feedback = 'down' AS negative, feedback = 'up' AS positive, coalesce(confidence < 0.75, false) OR coalesce(crag_decision = 'INCORRECT', false) AS low FROM v_messages WHERE feedback IS NOT NULL")
def b3(v):
    return v("v_messages").where("feedback is not null").select("message_id", (F.col("feedback") == "down").alias("negative"), (F.col("feedback") == "up").alias("positive"), reports.is_low().alias("low"))


@query("b4_allowed_domain", f"SELECT page_id, {_HOST} LIKE '%.example.org' OR {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.com' OR {_HOST} = 'example.com' AS allowed FROM pages")
def b4(v):
    return v("pages").select("page_id", U.is_allowed(F.col("url"), DOMAINS).alias("allowed"))


@query("b5_skippable", r"SELECT page_id, regexp_matches(url, '(?i)/logout|/logoff|/login|/signin|gazette.*(?:\.txt|\.pdf|\.csv)(?:$|[?#])|\.(?:txt|csv|log)(?:$|[?#])|\.(?:png|jpg|jpeg|gif|svg|ico|bmp|css|js|zip|rar|7z|tar|gz|mp3|mp4|exe)(?:$|[?#])') AS skip FROM pages")
def b5(v):
    return v("pages").select("page_id", U.is_skippable(F.col("url")).alias("skip"))


#: URLs with the host, or the scheme, of a part of the pages replaced.
_HOSTS = """CASE page_id % 5 WHEN 0 THEN 'http://' || CAST(page_id * 37 % 256 AS STRING) || '.' || CAST(page_id * 91 % 256 AS STRING) || '.0.' || CAST(page_id % 250 AS STRING) || '/x' WHEN 1 THEN 'http://' || CASE page_id % 4 WHEN 0 THEN 'localhost:80' WHEN 1 THEN '172.20.1.1' WHEN 2 THEN '192.168.0.9:8080' ELSE '169.254.169.254' END || '/'
WHEN 2 THEN replace(url, 'https://', 'ftp://') ELSE url END"""


@query("b6_safe_url", rf"""WITH u AS (SELECT page_id, {_HOSTS} AS url FROM pages), h AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {_HOST} AS host FROM u),
o AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN split_part(host, '.', 1)::INT END AS a, CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN split_part(host, '.', 2)::INT END AS b FROM h)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN host IN ('localhost', '127.0.0.1', '[::1]', '0.0.0.0') OR a = 127 THEN 'loopback' WHEN a >= 224 OR a = 0 OR (a = 169 AND b = 254) THEN 'unroutable' WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' ELSE 'ok' END AS safety FROM o""")
def b6(v):
    return v("pages").select("page_id", U.safety(F.expr(_HOSTS)).alias("safety"))


@query("b7_document_url", rf"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '?type=DOCX' ELSE url END AS url FROM pages)
SELECT page_id, regexp_matches(lower({_PATH}), '\.(pdf|docx|doc|xlsx|xls|pptx|ppt)$') OR regexp_matches(lower({_QUERY}), '(\.|type=|format=)(pdf|docx|doc|xlsx|xls|pptx|ppt)') AS is_document FROM u""")
def b7(v):
    n = F.col("page_id") % 3
    return v("pages").select("page_id", U.is_document(F.when(n == 0, F.concat("url", F.lit(".pdf"))).when(n == 1, F.concat("url", F.lit("?type=DOCX"))).otherwise(F.col("url"))).alias("is_document"))


#: Parts of file names that speak of handwriting.
HANDWRITTEN = "handwritten|hand_written|handwriting|hw_notes|exam_copy|answer_sheet"


def doc_type(path):
    """Kind of document by the ending and name of a file."""
    name, end = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    picture = end.isin("png", "jpg", "jpeg", "tiff", "bmp", "pdf")
    return F.when(picture & name.rlike(HANDWRITTEN), "handwritten").when(end.isin("png", "jpg", "jpeg", "tiff", "bmp"), "scanned").otherwise("born_digital")


#: Paths with the name and ending of a part of the files replaced.
_NEW_PATH = "CASE document_id % 5 WHEN 0 THEN replace(source_path, '.txt', '_answer_sheet.png') WHEN 1 THEN replace(source_path, '.txt', '.jpg') WHEN 2 THEN replace(source_path, 'doc_', 'hw_notes_') WHEN 3 THEN replace(source_path, '.txt', '.PDF') ELSE source_path END"
_KIND = f"CASE WHEN e IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'pdf') AND regexp_matches(n, '{HANDWRITTEN}') THEN 'handwritten' WHEN e IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp') THEN 'scanned' ELSE 'born_digital' END"
_KINDS = rf"WITH p AS (SELECT document_id, doc_type AS old_type, ocr_confidence AS c, {_NEW_PATH} AS path FROM v_documents), q AS (SELECT *, lower(split_part(path, '/', -1)) AS n, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS e FROM p), x AS (SELECT *, {_KIND} AS new_type FROM q) "


def _paths(v):
    return v("v_documents").select("document_id", F.expr(_NEW_PATH).alias("path"), "doc_type", "ocr_confidence")


@query("b8_document_type", _KINDS + "SELECT document_id, new_type AS doc_type FROM x")
def b8(v):
    return _paths(v).select("document_id", doc_type(F.col("path")).alias("doc_type"))


@query("b9_reclassify", _KINDS + "SELECT old_type, new_type, count(*) AS n, round(avg(CASE WHEN new_type <> 'born_digital' THEN coalesce(c, 0.88) END), 6) AS confidence FROM x GROUP BY ALL")
def b9(v):
    x = _paths(v).withColumn("new_type", doc_type(F.col("path")))
    c = F.when(F.col("new_type") != "born_digital", F.coalesce("ocr_confidence", F.lit(0.88)))
    return x.groupBy(F.col("doc_type").alias("old_type"), "new_type").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("confidence"))


@query("b13_binary_sniff", "SELECT CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'exe' ELSE 'text' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def b13(v):
    from corpusloom.sources.pages import sniff

    n = F.col("page_id") % 4
    body = F.concat(F.when(n == 0, "%PDF-1.4").when(n == 1, "PK\x03\x04").when(n == 2, "MZ").otherwise(""), F.col("html")).cast("binary")
    return v("pages").groupBy(sniff(body).alias("kind")).agg(F.count("*").alias("n"))


@query("b14_minimum_text", r"SELECT document_id, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 200 THEN 'skipped_empty' ELSE 'ok' END AS status FROM v_documents")
def b14(v):
    return v("v_documents").select("document_id", F.when(F.length(T.stripped(F.col("text"))) < 200, "skipped_empty").otherwise("ok").alias("status"))


@query("f2_page", "SELECT document_id, (SELECT count(*) FROM v_documents) AS total, (SELECT greatest(1, ceil(count(*) / 25.0)) FROM v_documents)::BIGINT AS total_pages FROM v_documents ORDER BY created_s DESC, document_id LIMIT 25 OFFSET 25")
def f2(v):
    return feeds.page(v("v_documents").select("document_id", "created_s"), [F.col("created_s").desc(), F.col("document_id")], 2, 25).select("document_id", "total", F.col("total_pages").cast("long").alias("total_pages"))


@query("f5_sorted", "SELECT document_id, title FROM v_documents ORDER BY title DESC, document_id LIMIT 50")
def f5(v):
    return v("v_documents").select("document_id", "title").orderBy(F.col("title").desc(), "document_id").limit(50)


@query("f6_incident_feed", "SELECT incident_id, event_type, severity FROM v_incidents WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY ts DESC, incident_id DESC LIMIT 25")
def f6(v):
    return reports.latest(v("v_incidents").where(F.col("severity").isin("CRITICAL", "HIGH")), [F.col("ts").desc(), F.col("incident_id").desc()], 25).select("incident_id", "event_type", "severity")


@query("g1_union_first_wins", """WITH a AS (SELECT document_id, 0 AS src, rank() OVER (ORDER BY document_id) AS r FROM v_documents WHERE document_id % 4 = 0), b AS (SELECT document_id, 1 AS src, rank() OVER (ORDER BY document_id DESC) AS r FROM v_documents WHERE document_id % 6 = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY src, r) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT document_id, src FROM u WHERE k = 1""")
def g1(v):
    d = v("v_documents").select("document_id")
    a, b = d.where("document_id % 4 = 0").withColumn("src", F.lit(0)), d.where("document_id % 6 = 0").withColumn("src", F.lit(1))
    return changes.first_of_equal(a.unionByName(b), ["document_id"], [F.col("src")])


@query("g3_frontier", "SELECT dst AS page_id FROM v_links EXCEPT SELECT page_id FROM pages WHERE page_id % 3 = 0")
def g3(v):
    return v("v_links").select(F.col("dst").alias("page_id")).distinct().join(v("pages").where("page_id % 3 = 0").select("page_id"), "page_id", "left_anti")


@query("g5_content_parity", "SELECT (SELECT count(*) FROM (SELECT page_id, url FROM pages EXCEPT ALL SELECT page_id, url FROM pages WHERE page_id % 9 <> 0)) AS only_source, 0::BIGINT AS only_target")
def g5(v):
    p = v("pages").select("page_id", "url")
    return changes.content_parity(p, p.where("page_id % 9 <> 0"))
