"""Queries over chat, audit, security and ingest tables (D, E and batch twins of I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import changes, feeds, lookups, reports

from .registry import query

_LOW = "(coalesce(confidence < 0.75, false) OR coalesce(crag_decision = 'INCORRECT', false))"


@query("d1_table_counts", "SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def d1(v):
    return reports.table_counts({n: v(n) for n in ("documents", "pages", "events")})


@query("d2_group_counts", "SELECT s.status, count(m.path) AS n FROM (VALUES ('done'), ('failed'), ('pending'), ('processing')) s(status) LEFT JOIN v_manifest_prev m ON m.status = s.status GROUP BY 1")
def d2(v):
    return reports.counts_of(v("v_manifest_prev"), "status", ["done", "failed", "pending", "processing"])


@query("d2_top_departments", "SELECT coalesce(department, 'unknown') AS department, count(*) AS n FROM v_documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def d2b(v):
    return reports.counts_of(v("v_documents"), "department", top=10)


@query("d3_conversation_health", f"""SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages, count(*) FILTER (feedback = 'up') AS up, count(*) FILTER (feedback = 'down') AS down,
CASE WHEN count(feedback) > 0 THEN round(100.0 * count(*) FILTER (feedback = 'up') / count(feedback), 1) ELSE 100 END AS satisfaction, count(*) FILTER {_LOW} AS low_confidence, round(avg(latency_ms), 1) AS mean_latency_ms FROM v_messages""")
def d3(v):
    return reports.conversation_health(v("v_messages"))


@query("d6_latency_percentiles", """WITH x AS (SELECT served_by, latency_ms, count(latency_ms) OVER (PARTITION BY served_by) AS n, row_number() OVER (PARTITION BY served_by ORDER BY latency_ms) - 1 AS i FROM v_audit)
SELECT served_by, max(latency_ms) FILTER (i = floor(n * 0.5)) AS p50, max(latency_ms) FILTER (i = floor(n * 0.9)) AS p90, max(latency_ms) FILTER (i = floor(n * 0.95)) AS p95, max(latency_ms) FILTER (i = floor(n * 0.99)) AS p99, round(avg(latency_ms), 3) AS mean FROM x GROUP BY served_by""")
def d6(v):
    return reports.latency_percentiles(v("v_audit"), "served_by", "latency_ms")


_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


@query("d7_latency_buckets", "WITH b AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]::DOUBLE[]) AS le) SELECT served_by, le::VARCHAR AS le, count(*) FILTER (latency_ms / 1000 <= le) AS n FROM v_audit, b GROUP BY ALL UNION ALL SELECT served_by, '+Inf', count(*) FROM v_audit GROUP BY ALL")
def d7(v):
    return reports.cumulative_buckets(v("v_audit"), "served_by", F.col("latency_ms") / 1000, _BOUNDS)


@query("d8_session_rollup", f"""SELECT session_id, count(*) AS message_count, substring(string_split(arg_min(content, (created_s, turn)) FILTER (sender = 'user'), chr(10))[1], 1, 80) AS title, bool_or({_LOW}) AS has_low_confidence,
bool_or(coalesce(feedback = 'down', false)) AS has_negative_feedback, sum(CASE feedback WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END)::BIGINT AS feedback_score, min(created_s) AS first_s, max(created_s) AS last_s FROM v_messages GROUP BY session_id""")
def d8(v):
    return reports.session_rollup(v("v_messages"))


def _gate(n):
    return f"""WITH x AS (SELECT * FROM v_audit ORDER BY ts DESC, audit_id DESC LIMIT {n}) SELECT count(*) AS n, count(*) FILTER (crag_decision = 'CORRECT') AS correct, count(*) FILTER (crag_decision = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (crag_decision = 'INCORRECT') AS incorrect,
round(100.0 * count(*) FILTER (crag_decision <> 'INCORRECT') / count(*), 1) AS hit_rate, count(*) FILTER (served_by = 'cache') AS by_cache, count(*) FILTER (served_by = 'local') AS by_local, count(*) FILTER (served_by = 'hosted') AS by_hosted, round(avg(latency_ms), 1) AS mean_latency_ms, round(avg(confidence), 3) AS mean_confidence FROM x"""


@query("d9_gate_diagnostics", _gate(100))
def d9(v):
    return reports.gate_diagnostics(v("v_audit"))


@query("d17_recent_telemetry", _gate(50))
def d17(v):
    return reports.gate_diagnostics(v("v_audit"), 50)


@query("d10_scorecard", """WITH c AS (SELECT audit_id % 3 = 0 AS a, crag_decision = 'CORRECT' AS hit, served_by <> 'hosted' AS cited, crag_decision = 'INCORRECT' AS abst, latency_ms FROM v_audit)
SELECT count(*) AS cases, round(avg(hit::INT) FILTER (NOT a), 6) AS hit_rate, round(avg(cited::INT) FILTER (NOT a), 6) AS citation_precision, round(avg(abst::INT) FILTER (a), 6) AS abstention_accuracy, round(avg(CASE WHEN a THEN abst ELSE hit END::INT), 6) AS pass_rate, round(avg(latency_ms), 3) AS mean_latency_ms FROM c""")
def d10(v):
    d = F.col("crag_decision")
    return reports.scorecard(v("v_audit").select((F.col("audit_id") % 3 == 0).alias("should_abstain"), (d == "CORRECT").alias("hit"), (F.col("served_by") != "hosted").alias("cited"), (d == "INCORRECT").alias("abstained"), "latency_ms"))


@query("d11_hierarchy", r"""WITH t AS (SELECT department, course, len(regexp_extract_all(text, '\S+')) AS tokens FROM v_documents)
SELECT department, course, count(*) AS documents, sum(tokens)::BIGINT AS tokens, array_to_string(list_sort(list_distinct(list(course)))[1:8], ',') AS courses, CASE grouping(department, course) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS level FROM t GROUP BY ROLLUP (department, course)""")
def d11(v):
    return reports.hierarchy(v("v_documents").select("department", "course", T.words_estimate(F.col("text")).alias("tokens")))


@query("d12_tree", """WITH b AS (SELECT department, course, document_id // 1000 AS part, list(document_id ORDER BY document_id) AS ids FROM v_documents GROUP BY ALL)
SELECT department, course, part, array_to_string(ids, ' ') AS ids FROM b""")
def d12(v):
    """The tree of departments, courses and documents: a leaf row for each thousand of ids, so that no course is one row."""
    c = v("v_documents").groupBy("department", "course", F.floor(F.col("document_id") / 1000).alias("part")).agg(F.sort_array(F.collect_list("document_id")).alias("ids"))
    return c.select("department", "course", "part", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("d13_crawl_stats", "SELECT http_status, count(*) AS visited, count(*) FILTER (http_status = 200) AS scraped, count(*) FILTER (http_status = 304) AS skipped, count(DISTINCT url) AS urls FROM v_crawl_now GROUP BY http_status")
def d13(v):
    return v("v_crawl_now").groupBy("http_status").agg(F.count("*").alias("visited"), F.count_if(F.col("http_status") == 200).alias("scraped"), F.count_if(F.col("http_status") == 304).alias("skipped"), F.countDistinct("url").alias("urls"))


@query("d15_scan_confidence", "SELECT doc_type, coalesce(round(avg(ocr_confidence), 3), 0.86) AS confidence FROM v_documents GROUP BY doc_type")
def d15(v):
    return v("v_documents").groupBy("doc_type").agg(F.coalesce(F.round(F.avg("ocr_confidence"), 3), F.lit(0.86)).alias("confidence"))


@query("d16_security", "SELECT count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (event_type = 'error') AS type_error, count(*) FILTER (event_type = 'click') AS type_click FROM v_incidents")
def d16(v):
    return reports.security_stats(v("v_incidents"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("d18_absorption", "SELECT round(1.0 * count(*) FILTER (served_by = 'cache') / count(*), 6) AS absorption, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 6) AS per_second FROM v_audit")
def d18(v):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return v("v_audit").agg(F.round(F.count_if(F.col("served_by") == "cache") / F.count("*"), 6).alias("absorption"), F.round(F.count("*") / (F.max(at) - F.min(at)) * 1e6, 6).alias("per_second"))


@query("d19_topics", """WITH q AS (SELECT lower(content) AS t FROM v_messages WHERE sender = 'user'), x AS (SELECT count(*) AS n, count(*) FILTER (contains(t, 'exam') OR contains(t, 'datesheet') OR contains(t, 'schedule')) AS n_exam,
count(*) FILTER (contains(t, 'admission') OR contains(t, 'apply') OR contains(t, 'form') OR contains(t, 'eligibility')) AS n_admission, count(*) FILTER (contains(t, 'fee') OR contains(t, 'hostel') OR contains(t, 'scholarship')) AS n_fees FROM q)
SELECT *, CASE WHEN n_exam > 0 THEN 'exam' WHEN n_admission > 0 THEN 'admission' WHEN n_fees > 0 THEN 'fees' ELSE 'precision' END AS topic FROM x""")
def d19(v):
    return reports.topic_of(v("v_messages").where("sender = 'user'"), "content", F.lit(False))


@query("d20_ingest_status", "SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status IN ('pending', 'processing')) AS left_over, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped_duplicate') AS duplicate, count(*) AS total FROM v_manifest_prev")
def d20(v):
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return v("v_manifest_prev").agg(is_("done").alias("done"), is_("pending", "processing").alias("left_over"), is_("failed").alias("failed"), is_("skipped_duplicate").alias("duplicate"), F.count("*").alias("total"))


@query("d21_rule_score", """WITH s AS (SELECT lang, text, [['en', 'the'], ['de', 'der'], ['fr', 'le'], ['es', 'de']] AS r FROM documents),
p AS (SELECT lang, contains(lower(text), CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'der' WHEN 'fr' THEN 'le' ELSE 'de' END) AND NOT contains(text, '!!') AND NOT contains(text, '###') AS ok FROM s)
SELECT lang, round(100.0 * avg(ok::INT), 1) AS pass_rate FROM p GROUP BY lang""")
def d21(v):
    must = F.create_map(*(F.lit(x) for k, w in (("en", "the"), ("de", "der"), ("fr", "le"), ("es", "de")) for x in (k, w)))
    d = v("documents").select("lang", "text", F.array(must[F.col("lang")]).alias("must"), F.array(F.lit("!!"), F.lit("###")).alias("never"))
    ok = F.forall("must", lambda w: F.contains(F.lower("text"), w)) & ~F.exists("never", lambda w: F.contains(F.col("text"), w))
    return d.groupBy("lang").agg(F.round(100.0 * F.avg(ok.cast("int")), 1).alias("pass_rate"))


def file_changes_sql(previous: str) -> str:
    """SQL of path and status (table c) of files: previous (path, oh, om, status) against v_scan_now."""
    return f"""p AS ({previous}), s0 AS (SELECT path, sha256(content) AS h, mtime FROM v_scan_now),
s AS (SELECT *, first_value(path) OVER (PARTITION BY h ORDER BY mtime, path) AS fp FROM s0), dn AS (SELECT oh AS h, min(path) AS a, max(path) AS b FROM p WHERE status = 'done' GROUP BY oh),
x AS (SELECT coalesce(p.path, s.path) AS path, oh, om, status, s.h, mtime, fp, a, a IS NOT NULL AND (a <> coalesce(p.path, s.path) OR b <> coalesce(p.path, s.path)) AS elsewhere FROM p FULL JOIN s ON p.path = s.path LEFT JOIN dn ON dn.h = s.h),
c AS (SELECT path, CASE WHEN h IS NULL THEN 'file_not_found' WHEN status = 'processing' THEN 'processing' WHEN status IS NULL THEN CASE WHEN a IS NOT NULL OR fp <> path THEN 'duplicate_skipped' ELSE 'new_file' END
WHEN status = 'skipped_duplicate' AND abs(mtime - om) <= 0.001 THEN 'duplicate_skipped'
WHEN (abs(mtime - om) > 0.001 OR status = 'failed') AND (h <> oh OR status = 'failed') THEN CASE WHEN elsewhere THEN 'duplicate_skipped' WHEN status = 'failed' THEN 'retry_failed' ELSE 'modified' END ELSE 'unchanged' END AS status FROM x)
"""


PREVIOUS = "SELECT path, sha256(content) AS oh, mtime AS om, status FROM v_manifest_prev"
FILE_CHANGES = "WITH " + file_changes_sql(PREVIOUS)


@query("c6_file_changes", FILE_CHANGES + "SELECT path, status FROM c")
def c6(v):
    return changes.file_changes(v("v_manifest_prev"), v("v_scan_now"))


@query("d22_scan_summary", FILE_CHANGES + "SELECT status, count(*) AS n FROM c GROUP BY status")
def d22(v):
    return changes.file_changes(v("v_manifest_prev"), v("v_scan_now")).groupBy("status").agg(F.count("*").alias("n"))


@query("e1_last_message", "SELECT session_id, CASE WHEN length(content) > 90 THEN substring(content, 1, 90) || '...' ELSE content END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_s DESC, turn DESC) AS k FROM v_messages) WHERE k = 1")
def e1(v):
    m = changes.first_of_equal(v("v_messages"), ["session_id"], [F.col("created_s").desc(), F.col("turn").desc()])
    return m.select("session_id", T.preview(F.col("content"), 90).alias("preview"))


@query("e2_message_numbers", r"SELECT message_id, row_number() OVER (PARTITION BY session_id ORDER BY turn, message_id) AS chunk_index, length(content) AS n_chars, len(regexp_extract_all(content, '\S+')) AS n_words FROM v_messages")
def e2(v):
    m = feeds.numbered(v("v_messages"), ["session_id"], [F.col("turn"), F.col("message_id")], "chunk_index", 1)
    return m.select("message_id", "chunk_index", F.length("content").cast("long").alias("n_chars"), T.words_estimate(F.col("content")).alias("n_words"))


@query("e3_ranks", "SELECT audit_id, row_number() OVER (PARTITION BY user_id ORDER BY latency_ms DESC, audit_id) - 1 AS rank FROM v_audit")
def e3(v):
    return feeds.numbered(v("v_audit"), ["user_id"], [F.col("latency_ms").desc(), F.col("audit_id")]).select("audit_id", "rank")


@query("e4_repeats_within", "SELECT message_id FROM (SELECT message_id, row_number() OVER (PARTITION BY session_id, sha256(content) ORDER BY turn) AS k FROM v_messages) WHERE k = 1")
def e4(v):
    return changes.first_of_equal(v("v_messages").withColumn("hash", T.sha256(F.col("content"))), ["session_id", "hash"], [F.col("turn")]).select("message_id")


@query("e5_repeats_across", "SELECT path, first_value(path) OVER (PARTITION BY sha256(content) ORDER BY mtime, path) AS first_path FROM v_scan_now")
def e5(v):
    return changes.same_file(v("v_scan_now").select("path", T.sha256(F.col("content")).alias("hash"), "mtime")).select("path", "first_path")


@query("e6_capped_titles", """SELECT audit_id FROM (SELECT audit_id, served_by = 'hosted' AS f, latency_ms, sum((served_by = 'hosted')::INT) OVER (PARTITION BY user_id ORDER BY latency_ms DESC, audit_id ROWS UNBOUNDED PRECEDING) AS n FROM v_audit) WHERE (NOT f OR n <= 2) AND latency_ms >= 0.2""")
def e6(v):
    x = feeds.capped_flags(v("v_audit"), ["user_id"], [F.col("latency_ms").desc(), F.col("audit_id")], F.col("served_by") == "hosted", 2)
    return x.where("latency_ms >= 0.2").select("audit_id")


@query("e7_citations", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY session_id, sender ORDER BY turn) AS k FROM v_messages), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r FROM a WHERE k = 1)
SELECT session_id, sender, CASE WHEN length(content) > 220 THEN substring(content, 1, 220) || '...' ELSE content END AS snippet FROM b WHERE r <= 3""")
def e7(v):
    one = changes.first_of_equal(v("v_messages"), ["session_id", "sender"], [F.col("turn")])
    return feeds.top_k(one, ["session_id"], [F.col("turn")], 3).select("session_id", "sender", T.preview(F.col("content"), 220).alias("snippet"))


@query("e8_balanced_sample", "SELECT document_id FROM (SELECT document_id, row_number() OVER (PARTITION BY course ORDER BY document_id) > 8 AS late FROM v_documents) ORDER BY late, document_id LIMIT 45")
def e8(v):
    return feeds.balanced(v("v_documents"), "course", ["document_id"], 8, 45).select("document_id")


@query("e10_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def e10(v):
    return v("events").select("event_id", lookups.sliding_count(v("events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 3600).alias("n"))


@query("i5_alerts", """WITH p AS (SELECT epoch_us(ts) // 60000000 AS m, latency_ms, (crag_decision = 'INCORRECT')::INT AS bad, (served_by = 'cache')::INT AS hit FROM v_audit),
f AS (SELECT m + k AS m, count(*) AS n, round(avg(bad), 6) AS error_share, round(list_sort(list(latency_ms))[least(floor(count(*) * 0.95)::BIGINT + 1, count(*))], 3) AS p95_ms FROM p, range(5) r(k) GROUP BY ALL),
q AS (SELECT m + k AS m, round(avg(hit), 6) AS cache_share FROM p, range(15) r(k) GROUP BY ALL)
, a AS (SELECT m, n, error_share, p95_ms, cache_share, p95_ms > 1000 AS slow, error_share > 0.05 AS failing, cache_share < 0.2 AS cold FROM f JOIN q USING (m))
SELECT m AS minute, n, error_share, p95_ms, cache_share, slow, failing, cold, count(*) FILTER (slow) OVER (ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 AS slow_fires,
count(*) FILTER (failing) OVER (ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS failing_fires, count(*) FILTER (cold) OVER (ORDER BY m RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) = 31 AS cold_fires FROM a""")
def i5(v):
    return reports.alerts(v("v_audit"), 1000)


@query("i7_sessions", """WITH a AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events), b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800, true)::INT AS s FROM a),
c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, min(t) AS start_s, max(t) AS end_s, count(*) AS n FROM c GROUP BY user_id, k""")
def i7(v):
    return lookups.islands(v("events"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")), 1800)


@query("i8_repeat_questions", "SELECT message_id, since_s FROM (SELECT message_id, asked_s - lag(asked_s) OVER (PARTITION BY department, question ORDER BY asked_s, message_id) AS since_s FROM v_asking) WHERE since_s <= 3600")
def i8(v):
    """Questions of users that repeat a whole question in a department within the hour; every second one is a short one that many ask."""
    m = v("v_asking").withColumn("key", T.sha256(F.concat_ws("|", "department", "question")))
    return lookups.earlier_repeats(m, ["key"], "asked_s", 3600).select("message_id", "since_s")


_ALONE = r"sha256(department || '|' || regexp_replace(lower(content), '^\s+|\s+$', '', 'g'))"


@query("i8_repeat_questions_whole", f"WITH m AS (SELECT message_id, created_s, lag(created_s) OVER (PARTITION BY {_ALONE} ORDER BY created_s) AS p FROM v_messages WHERE sender = 'user') SELECT message_id, created_s - p AS since_s FROM m WHERE created_s - p <= 3600")
def i8_whole(v):
    """The same over the messages as they are; messages have no course."""
    m = v("v_messages").where("sender = 'user'").withColumn("key", T.sha256(F.concat_ws("|", "department", T.stripped(F.lower("content")))))
    return lookups.earlier_repeats(m, ["key"], "created_s", 3600).select("message_id", "since_s")
