"""Queries of streaming jobs, run over what the tables hold now (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ingest import Library
from corpusloom.sources.scratch import materialise, new_path
from corpusloom.streaming import jobs

from .registry import query
from .retrieval import ingest_sql
from .views import VIEWS


def _stream(v, table: str):
    """A table of the input folder as a file stream: of its files, if it is a folder, and else of that file beside the others."""
    path = f"{v.dir}/{table}.parquet"
    target = v.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = v.spark.readStream.schema(v(table).schema)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{table}.parquet").parquet(v.dir)


def _collected(v, rows, mode="append"):
    """The table a finished stream leaves."""
    parts = []
    q = jobs.start(rows, new_path(v.spark, "loom-streams"), mode, each=lambda d, _: parts.append(materialise(d)))
    q.awaitTermination()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("i1_stream_ingest", "WITH w AS (SELECT path, sha256(content) AS oh, mtime AS om, content, first_value(path) OVER (PARTITION BY sha256(content) ORDER BY mtime, path) AS fp FROM v_manifest_prev), " + ingest_sql("SELECT path, oh, om, CASE WHEN fp = path THEN 'done' ELSE 'skipped_duplicate' END AS status FROM w", "SELECT path, om AS mtime, content FROM w WHERE fp = path") + "SELECT path, chunk_index, content_hash FROM ch")
def i1(v):
    """Files that arrive in two waves, the second with modified ones: what the library holds then. A stream that is started anew goes on
    from its checkpoint, so that the second wave alone is read."""
    folder, checkpoint = new_path(v.spark, "loom-files"), new_path(v.spark, "loom-streams")
    library = Library(v.spark, new_path(v.spark, "loom-library"), 16)
    for wave in ("v_manifest_prev", "v_scan_now"):
        v(wave).select("path", "content", F.col("mtime").cast("long").alias("mtime")).write.mode("append").parquet(folder)
        files = v.spark.readStream.schema("path string, content string, mtime long").parquet(folder)
        library.follow(files, checkpoint).awaitTermination()
    return library.chunks.read().select("path", "chunk_index", "content_hash")


#: A limiter of 3 an hour and user, an attempt at a time.
_LIMITED = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, at_us, history, admitted) AS (SELECT user_id, n, at_us, [at_us], true FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.n, e.at_us, CASE WHEN len(list_filter(r.history, lambda h: h > e.at_us - 3600000000)) < 3 THEN list_filter(r.history, lambda h: h > e.at_us - 3600000000) || [e.at_us] ELSE list_filter(r.history, lambda h: h > e.at_us - 3600000000) END, len(list_filter(r.history, lambda h: h > e.at_us - 3600000000)) < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, at_us, admitted FROM r"""


def _attempts(events):
    return events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query("i3_rate_limit", _LIMITED)
def i3(v):
    """Attempts let in at 3 an hour and user, by a stream with keyed state."""
    with jobs.keyed_state(v.spark):
        return _collected(v, jobs.limited(_attempts(_stream(v, "events")), 3600, 3))


@query("i3_rate_limit_batch", _LIMITED)
def i3_batch(v):
    """The same over the table, as a fold over the sorted attempts of each client."""
    return jobs.limited_batch(_attempts(v("events")), 3600, 3)


@query("i8_stream_repeats", "SELECT message_id, since_s FROM (SELECT message_id, asked_s - lag(asked_s) OVER (PARTITION BY department, question ORDER BY asked_s, message_id) AS since_s FROM v_asking) WHERE since_s <= 3600")
def i8_stream(v):
    """Repeat questions within an hour, by a stream with keyed state."""
    c = v.spark.sql(VIEWS["v_asking"][1], conversations=_stream(v, "conversations"))
    with jobs.keyed_state(v.spark):
        return _collected(v, jobs.repeated(c.select("message_id", T.sha256(F.concat_ws("|", "department", "question")).alias("key"), "asked_s")))


@query("i5_stream_health", """WITH w AS (SELECT epoch_us(ts) // 60000000 - k AS m, latency_ms, (crag_decision = 'INCORRECT')::INT AS bad, (served_by = 'cache')::INT AS hit FROM v_audit, range(5) r(k))
SELECT m * 60 AS start_s, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(avg(bad), 6) AS error_share, round(avg(hit), 6) AS cache_share FROM w GROUP BY m HAVING (m + 5) * 60 <= (SELECT epoch_us(max(ts)) / 1000000 - 600 FROM v_audit)""")
def i5_stream(v):
    """Health by sliding window, as a stream emits it: windows that ended before the watermark."""
    e = _stream(v, "events")
    audit = v.spark.sql(VIEWS["v_audit"][1], events=e).withColumn("ts", F.col("ts").cast("timestamp"))
    h = _collected(v, jobs.windowed_health(audit))
    return h.select(F.unix_seconds("start").alias("start_s"), "n", *(F.round(c, 6).alias(c) for c in ("mean_ms", "error_share", "cache_share")))


@query("i7_stream_sessions", """WITH a AS (SELECT user_id, epoch_us(ts) AS t FROM events), b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800000000, true)::INT AS s FROM a),
c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM c GROUP BY user_id, k HAVING max(t) + 1800000000 <= (SELECT max(t) - 600000000 FROM a)""")
def i7_stream(v):
    """Sessions of inactivity, as a stream emits them: those that ended before the watermark."""
    e = _stream(v, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = _collected(v, jobs.inactivity_sessions(e))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("i9_progress", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events")
def i9(v):
    """Counters that the batches of a stream report in their progress, added up by a listener."""
    rows = jobs.counted(_stream(v, "events"), "progress", n=F.count("*"), errors=F.count_if(F.col("event_type") == "error"))
    sums = jobs.totals(rows, "progress", new_path(v.spark, "loom-streams"), lambda d, _: d.write.format("noop").mode("append").save()).sums
    return v.spark.createDataFrame([(sums["n"], sums["errors"])], "n long, errors long")


@query("i4_stream_dedup", "SELECT count(DISTINCT text) AS n FROM documents")
def i4(v):
    docs = _stream(v, "documents").select("doc_id", "text", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return _collected(v, jobs.first_of_content(docs, "ts", "text")).agg(F.count("*").alias("n"))


@query("i6_running_sessions", "SELECT 's_' || conv_id AS session_id, count(*) AS message_count FROM conversations GROUP BY 1")
def i6(v):
    m = _stream(v, "conversations").select(F.concat(F.lit("s_"), F.col("conv_id").cast("string")).alias("session_id"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("crag_decision"), F.lit(None).cast("string").alias("feedback"))
    return _collected(v, jobs.running_sessions(m), "update").groupBy("session_id").agg(F.max("message_count").alias("message_count"))
